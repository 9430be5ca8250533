import collections
import math
import re

from pyspark.sql import functions as F

from veinstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts, covered = collections.Counter(grams), set()
    for k, gram in enumerate(grams):
        if counts[gram] > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def distance(p, q):
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))


def test_base_against_brute_force(spark, odd):
    more = spark.createDataFrame([(900, "a b c d e f g h " * 2), (901, ("one two three four five six seven eight nine\n" * 4) + "tail"), (902, "x\n \nx\nx \n#|<>")], "doc_id long, text string")
    rows = quality.judged(odd.select("doc_id", "text").unionByName(more), F.col("text")).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(r.text or "")
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (r.kept and r.base_failed)


def test_divergence(spark):
    prose = "The report of the committee was sent to a member in the spring, and it is by this that all of us are at work on the plan for a bridge. " * 1
    rng = [f"{prose}Paragraph {k} tells what was seen from the river with as much care as can be had, and that is for the reader to weigh.\n" for k in ("one", "two", "three", "four", "five")]
    good, shouted, signs = "".join(dict.fromkeys(rng)), "".join(rng).upper(), "".join(rng).replace(" ", "$$$ ")
    docs = spark.createDataFrame([(0, good), (1, shouted), (2, signs)], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.divergence_columns(quality.base_columns(docs, F.col("text"))).collect()}
    classes = [len(re.findall(p, good)) for p in ("[a-z]", "(?!)", "[A-Z]", "[0-9]", r"\s", r"""[.,;:!?'"()-]""")]
    shares = [c / len(good) for c in classes] + [0.0]
    assert abs(found[0].char_distance - min(distance(shares, v) for v in quality.CLASS_SHARES.values())) < 1e-9
    tokens = re.findall("[a-z]+", good.lower())
    counts = lambda words: [tokens.count(w) / len(tokens) for w in words] + [sum(t not in words for t in tokens) / len(tokens)]
    assert abs(found[0].word_distance - min(distance(counts(w), quality.word_shares(k)) for k, w in ((k, list(w)) for k, w in quality.COMMON_WORDS.items()))) < 1e-9
    assert found[1].char_distance > 0.4 and found[2].char_distance > 0.25


def test_keeps_clean_and_drops_bad(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judged(labelled, F.col("text")).where("NOT base_failed AND n_words >= 60").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_languages(spark):
    """Plain prose of the references' languages stays, whatever the column says; of others it goes."""
    texts = {
        "en": "In the morning the men went down to the river and looked at the bridge that had been built by the people of the town. It was a long way, and the road was not good, but they had the time for it. He said that the water was high for the season, and that it would be better to wait on the bank with the others. From the hill at the end of the valley the house is seen as it was in the days of his father, and this is what he wanted to be at.",
        "de": "Am Morgen gingen die Männer zu dem Fluss und sahen sich die Brücke an, die von den Leuten der Stadt gebaut worden war. Es war ein langer Weg, und die Straße ist nicht gut, aber sie hatten Zeit für den Gang. Er sagte, dass das Wasser im Frühling hoch sei und es besser ist, mit den anderen auf die Fähre zu warten. Von dem Hügel an dem Ende des Tals sieht man das Haus so, wie es in den Tagen des Vaters war, und auch das ist ein Grund, sich auf den Weg zu machen.",
        "es": "Por la mañana los hombres bajaron al río y miraron el puente que la gente de la ciudad había hecho con las piedras de una casa. No es un camino corto, y el suelo no era bueno, pero se tomaron el día para andar por él. Dijo que el agua del río es alta en la primavera, y que lo mejor era esperar con los otros a la orilla del lago. Desde lo alto de la colina se ve la casa como era en los días de su padre, y es por eso que a él le gusta más que todas las de la región.",
        "pl": "Rano mężczyźni poszli nad rzekę i oglądali most, który zbudowali mieszkańcy miasta. Była to długa droga, a ścieżka nie była dobra, ale mieli czas na spacer. Powiedział, że woda wiosną jest wysoka i że lepiej poczekać razem z innymi na brzegu. Ze wzgórza na końcu doliny widać dom taki, jaki był za czasów jego ojca, i dlatego chciał tam wrócić. Potem usiedli przy ogniu i długo rozmawiali o podróżach, o dawnych przyjaciołach i o tym, co przyniesie następny rok, kiedy wszyscy znowu się spotkają.",
    }
    docs = spark.createDataFrame([(k, " ".join([t, t[: len(t) // 6]])) for k, t in texts.items()], "doc_id string, text string")
    kept = {r.doc_id: r.kept for r in quality.judged(docs, F.col("text")).collect()}
    assert kept == {"en": True, "de": True, "es": True, "pl": False}
