"""Rule tables as data. Every function that uses one takes it as a parameter with these defaults."""

from __future__ import annotations

# Content types by file name, then by folder; the first match holds.
FILE_TYPES = [
    ("消费者权益保护实施办法", "法规制度"), ("调查报告", "调查报告"), ("风险揭示书", "理财风险揭示书"),
    ("基金产品资料概要", "基金产品资料概要"), ("季度报告", "公司定期报告"), ("年度报告", "公司定期报告"),
]
FOLDER_TYPES = [
    ("上市公司年报", "公司定期报告"), ("基金产品", "基金产品资料概要"), ("银行理财", "理财风险揭示书"),
    ("宏观经济", "宏观经济与政策"), ("用户FAQ", "投资者教育FAQ"),
]
OTHER_TYPE, FACT_TYPE, FACT_SECTION = "其他", "公司定期报告", "主要会计数据"

# File types taken in, prefixes passed over.
EXTENSIONS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".md"]
SKIPPED_PREFIXES = ("~$", ".")

# Block types dropped, image types, limits on images, the mark of an image without content.
DROPPED_BLOCKS, IMAGE_BLOCKS = ("header", "footer", "page_number"), ("image", "chart")
LEAST_IMAGE_SIDE, NO_CONTENT = 200, "无信息图片"

# Numbering styles of headings and their levels, in order; the first match holds.
NUMERALS = "一二三四五六七八九十百零〇两"
HEADING_LEVELS = [
    (rf"第[{NUMERALS}\d]+\s*(?:部分|篇|章)", 2), (rf"第[{NUMERALS}\d]+\s*节", 3), (rf"[{NUMERALS}]+\s*[、.．]", 3),
    (rf"[{NUMERALS}]+\s+\S", 3), (rf"[（(]\s*[{NUMERALS}]+\s*[)）]", 4), (r"专栏\s*\d+", 4), (r"\d+\.\d+\.\d+", 5),
    (r"\d+\.\d+(?![.\d])", 4), (r"\d+\s*[、.．](?!\d)", 5), (r"\d{1,2}\s+[^\d\s年月日]", 3), (r"[（(]\s*\d+\s*[)）]", 6), (r"[①-⑳]", 7),
]
HEADING_MOST, HEADING_BAD_ENDS, HEADING_BAD_MARK = 60, "，,；;、", "□"
ORPHAN_LEVEL, DEEPEST_CHILD = 9, 8
UNIT_LINE, UNIT_LINE_MOST = r"[（(]?\s*(?:单位|金额单位|货币单位)\s*[:：]", 40
PARAGRAPH_ENDS = "。！？!?；;：:”」』）)]"

# Table cells.
UNIT_CELL = r"[（(][^（()）]*(?:元|币|股|%|单位)[^（()）]*[)）]"
NUMBER_CELL = r"[-+−(（]?[\d,，]+(?:\.\d+)?%?[)）]?"
HEADER_CELL_MOST, LABEL_CELL_MOST, FIRST_COLUMN = 30, 40, "项目"

# Chunking.
CHUNK_TARGET, CHUNK_MOST, CHUNK_LEAST, TABLE_MOST = 600, 1000, 200, 3000
SUMMARY_MOST, ENTITY_MOST, SUMMARY_PREFIX = 6000, 3000, "（文档摘要）"
CHUNK_SENTENCE_ENDS = "。！？!?；;\n"

# Retrieval.
CANDIDATES, FUSED, FINAL, RRF_K, TOP_K = 30, 20, 8, 60, 5
RERANK_CHARS, PROMPT_CHARS, BATCH = 2000, 1500, 64
PATH_BYTES, TEXT_BYTES = 1024, 65535

# Answers.
BANNED = ["一定赚钱", "保证收益", "保本无风险", "稳赚不赔", "一定会上涨", "现在必须买入", "保本保息", "零风险", "稳赚", "包赚", "肯定涨"]
NEGATIONS = ["不承诺", "不存在", "并不", "并非", "绝非", "没有", "不能", "不会", "不得", "不是", "不", "非", "无"]
NEGATION_CHARS = 4
WARNINGS = ["非法集资", "集资诈骗", "诈骗", "骗局", "警惕", "谨防", "不法分子", "违规承诺"]
ADVICE = r"(?:建议|推荐)(?:您|你)?(?:现在|立即|马上)?(?:买入|卖出|持有|赎回|加仓|减仓|抄底|清仓|购买|入手)"
GUARD_REPLACEMENT = "（此处原有不符合合规要求的表述，已删除。金融产品存在风险，不存在保证收益的承诺。）"
GUARD_SENTENCE_ENDS = "。！？!?\n"
CITATION = r"[\[【]E(\d+)[\]】]"
META_MARK = "<<<META>>>"
KINDS = ["answer", "refuse", "clarify", "decline_advice", "realtime_notice", "chitchat"]
REFUSE = "当前知识库中未检索到足够信息，建议查看正式产品文件、公告原文或咨询相关工作人员。"
REALTIME = "知识库中没有实时行情、最新净值或实时价格数据，无法提供当前数值。请通过交易所、基金管理人或银行官网等官方渠道查询最新信息。"
DECLINE_ADVICE = "我只能提供金融知识查询和资料解读，不能告诉您应该买入、卖出、持有或赎回某个产品，也无法预测价格涨跌。如需做投资决策，请结合自身风险承受能力，参考正式产品文件，必要时咨询持牌专业人士。"
CHITCHAT = "您好，我是金融知识库助手，可以帮您查询金融产品资料、公司公告、宏观政策、金融知识和常见业务流程。"
NOTICES = {
    "risk": "风险提示：金融产品存在风险；历史业绩不代表未来表现；投资需结合自身风险承受能力；正式信息以产品合同、招募说明书、公告原文和监管文件为准。",
    "realtime": "时效提示：知识库资料可能存在滞后，最新行情、净值、公告和实时价格请以官方渠道或实时数据源为准。",
}
CLARIFY_HEAD, CLARIFY_TAIL = "知识库中有多个可能的对象，请问您指的是哪一个？", "请回复序号或名称。"

# What a planning model reads, and what stands for nothing in it.
NOTHING = "（无）"
PLAN_TEMPLATE = "对话历史：\n{history}\n\n当前焦点对象：{focus}\n\n当前问题：{question}"

# Entities.
ENTITY_TYPES = ["company", "fund", "wealth_product", "document"]
MOST_ALIASES, FUZZY_LEAST = 8, 4
GENERIC = [
    "基金", "理财", "理财产品", "产品", "银行", "公司", "报告", "公告", "股票", "ETF", "私募基金", "债券基金", "货币基金", "股票基金", "混合基金",
    "指数基金", "基金公司", "证券公司", "上市公司", "资料", "投资者教育资料", "投教资料", "季报", "年报", "季度报告", "年度报告", "风险揭示书", "产品说明书", "问答",
]
BOILERPLATE = (
    "股份有限公司|有限责任公司|有限公司|交易型开放式指数证券投资基金|证券投资基金|投资基金|联接基金|基金|理财产品|理财计划|理财|产品|那只|那款|这只|这款|的"
)
ORDINAL_REPLY, ORDINALS = r"第?\s*([1-4一二三四])\s*(?:个|只|款|项)?[。.！!]?", {"1": 0, "2": 1, "3": 2, "4": 3, "一": 0, "二": 1, "三": 2, "四": 3}
REPLY_NOISE = r"[，。,.！!？?\s]|那只|那个|那款|这只|这个|的|吧|呢|是|就"

# Evaluation.
CATEGORIES = ["product", "announcement", "risk", "knowledge", "process", "negative", "compliance", "multiturn"]
EXPECTS = ["answer", "refuse", "clarify", "decline_advice", "realtime_notice"]
HIT_LEVELS, QUOTE_LEAST, QUOTE_MOST = (1, 3, 5, 10), 4, 60
QUESTION_MOST, TITLE_CHARS, HISTORY_CHARS, HISTORY_TURNS = 500, 40, 200, 3

# Error classes and what a user is told, in order; listings.
ERRORS = [
    (("PermissionDeniedError", "AuthenticationError", "RateLimitError"), "大模型服务暂时不可用（账户或额度问题），请稍后再试或联系管理员。"),
    (("APIConnectionError", "APITimeoutError", "Timeout", "ReadTimeout", "ConnectionError"), "大模型服务连接超时，请稍后重试。"),
    (("ServerSelectionTimeoutError", "AutoReconnect"), "会话数据库连接失败，请稍后重试。"),
    (("MilvusException",), "知识库检索服务连接失败，请稍后重试。"),
]
OTHER_ERROR = "服务处理出错，请稍后重试。"
MOST_SESSIONS, MOST_MESSAGES, MOST_TASKS = 30, 200, 50
EVAL_TOP, EVAL_KEPT = 10, 5
