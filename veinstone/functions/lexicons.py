"""Word lists, patterns and labels that results depend on."""

AGENT_WORDS = [
    "python", "代码", "运行", "计算", "图谱", "neo4j", "关系", "因果", "影响", "trace", "sandbox", "沙盒", "仿真", "模拟", "绘制", "曲线", "绘图", "画图", "图表", "图像",
    "图片", "可视化", "plot", "chart", "curve", "绘画", "作图", "制图", "折线图", "柱状图", "条形图", "饼图", "散点图", "画个", "画一下", "画出",
]
CHITCHAT_WORDS = ["你好", "hello", "hi", "是谁", "主子", "名字", "自我介绍", "谢谢", "再见", "再会", "拜拜"]
INSTRUCTION_CUES = ["ignore", "忽略", "override", "覆盖", "system", "系统", "forget", "忘记", "disregard", "无视", "you are", "你是", "new instruction", "新指令"]
NO_RESULT_MARKERS = ["no results", "未找到", "没有找到", "无结果", "no documents", "empty"]
FIGURE_WORDS = ["图", "表", "fig", "chart", "graph", "photo", "sem", "tem"]
NODE_LABELS = ["Material", "Property", "Process", "Structure", "Equipment"]
RELATIONS = ["has_property", "has_structure", "processed_by", "uses_equipment", "improves", "degrades", "influences", "affects", "contains", "produces"]
#: In order of progress; the last but one two are failures.
STAGES = ["started", "parsing", "chunking", "figures", "indexing", "graphing", "verifying", "verify_failed", "completed", "failed"]
CALLBACK_STAGES = ["parsing", "chunking", "figures", "indexing", "graphing", "verifying"]
INTERVENTION = "[系统干预]"
NO_CONTENT = "Worker completed but produced no textual output"
#: First match counts.
BLOCK_TYPES = [
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "DT"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
]
SIMPLE_TOKEN = "[\u4e00-\u9fff]+|[a-zA-Z0-9]+"
#: The characters of simple tokens.
SIMPLE_CLASS = "\u4e00-\u9fffa-zA-Z0-9"
TRUE_WORDS = r"^(true|yes|是|\*|✓|✔|☑|✅|√)$"
FALSE_WORDS = r"^(false|no|否|⍻|×)$"
CAPTION = r"^(图\s*|Figure|FIG\.?|Fig\.?|表\s*|Table|TABLE)\s*[\d.\-]+"
SPECIAL_SIGNS = r"[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+"
ILLEGAL_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CITATION = (
    r"(?i)\[来源[：:].*?\]|来源页码[：:]\s*\d+|（来源.*?页码.*?\d+）|p\.\s*\d+|pp\.\s*\d+|\[?\d+\]|第\s*\d+\s*页|图\s*\d+|Figure\s*\d+|"
    r"page\s*\d+|fig\.\s*\d+|来源[：:].*|参考.*?页|见.*?图|如.*?所示"
)
#: Finds something in the same texts as CITATION does, with less reading: only where one may begin, and no further than needed to know.
ANY_CITATION = r"(?i)(?=[来（p0-9第图f参见如])(?:来源[：:]|来源页码[：:]\s*\d|（来源.*?页码.*?\d+）|p\.\s*\d|\d\]|第\s*\d+\s*页|图\s*\d|Figure\s*\d|page\s*\d|fig\.\s*\d|参考.*?页|见.*?图|如.*?所示)"
#: Lenient dates, in this order.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd"]
#: Signs of the query language.
QUERY_SIGNS = r"""[\+\-\=\&\|><!\(\)\{\}\[\]\^"~\*\?:\\/]"""
#: Punctuation, spaces among it, that pre-tokens are without.
PRETOKEN_SIGNS = r"""[~—\t @#%!<>,\.\?":;'\{\}\[\]_=\(\)\|，。？》•●○↓《；‘’：“”【¥ 】…￥！、·（）×`&\\/「」]"""
FIGURE_MENTION = r"(?i)(图|figure|fig\.?)\s*\d+"
#: What a term's kind multiplies its weight by; 1 for others.
KIND_WEIGHTS = {"toxic": 2, "func": 1, "corp": 3, "loca": 3, "sch": 3, "stock": 3, "firstnm": 1}
