"""Fixed values for texts: patterns and word lists as plain text.

Results depend on these exact values.  Operators take them as parameters, so a rule set for another
language can be passed in; English companions stand next to the Chinese lists.
"""

# --- fixed values: statistical methods (key, pattern) -----------------------------------------
METHOD_PATTERNS = (
    ("independent_t", r"(?i)独立样本\s*T\s*检验|independent[\s-]*samples?\s*t[\s-]*test"),
    ("paired_t", r"(?i)配对\s*T\s*检验|配对样本\s*T\s*检验|paired[\s-]*samples?\s*t[\s-]*test"),
    ("one_sample_t", r"(?i)单样本\s*T\s*检验|one[\s-]*sample\s*t[\s-]*test"),
    ("anova", r"(?i)单因素方差分析|单因素\s*ANOVA|one[\s-]*way\s*ANOVA"),
    ("two_way_anova", r"(?i)双因素方差分析|双因素\s*ANOVA|two[\s-]*way\s*ANOVA"),
    ("repeated_measures_anova",
     r"(?i)重复测量(?:方差分析|ANOVA)|被试内(?:设计|方差分析|ANOVA)|组内设计|repeated[\s-]*measures|mixed[\s-]*ANOVA"),
    ("correlation", r"(?i)Pearman\s*相关|Pearson\s*相关|Pearson\s*correlation|皮尔逊相关"),
    ("spearman", r"(?i)Spearman\s*相关|斯皮尔曼|等级相关"),
    ("chi_square", r"(?i)卡方检验|χ\s*²\s*检验|chi[\s-]*square|χ\s*²\s*test"),
    ("mann_whitney", r"(?i)Mann[\s-]*Whitney|MW\s*检验|曼[\s-]*惠特尼"),
    ("wilcoxon", r"(?i)Wilcoxon\s*符号秩|Wilcoxon\s*秩和|威尔科克森|配对秩和"),
    ("kruskal_wallis", r"(?i)Kruskal[\s-]*Wallis|克鲁斯卡尔"),
    ("linear_regression",
     r"(?i)线性回归|多元回归|linear\s*regression|\bOLS\b|最小二乘|ordinary\s+least\s+squares"),
    ("logistic_regression",
     r"(?i)logistic\s*回归|逻辑回归|二元逻辑|binary\s+logistic|logit\s*模型|logit\s*regression|\blogit\b"),
    ("cronbach_alpha",
     r"(?i)Cronbach'?s?\s*α|Cronbach'?s?\s*alpha|克隆巴赫|克朗巴哈|内部一致性(?:系数|信度)?|信度分析|信度系数"),
    ("regression", r"(?i)回归分析|regression"),
    ("non_parametric", r"(?i)非参数检验"),
)

#: A whole count: all its digits, thousands separated or not, and no decimals.
_SIZE = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?![\d.,]*\d)"

# --- fixed values: reported quantities (kind -> pattern) ---------------------------------------
QUANTITY_PATTERNS = {
    "p": r"(?<![A-Za-z])[Pp]\s*[<>=≤≥＜＞＝]\s*(?:0?\.\d+|1\.0+(?!\d)|[01](?![\d.]))",
    "t": r"[Tt]\s*(?:\(\s*\d+\s*\))?\s*=\s*-?\d+\.?\d*",
    "f": r"[Ff]\s*(?:\(\s*\d+\s*,\s*\d+\s*\))?\s*=\s*\d+\.?\d*",
    "chi2": r"χ\s*²\s*(?:\(\s*\d+\s*\))?\s*=\s*\d+\.?\d*|[Xx]\s*²\s*(?:\(\s*\d+\s*\))?\s*=\s*\d+\.?\d*"
            r"|(?i:chi[\s-]*square)\s*(?:\(\s*\d+\s*\))?\s*=\s*\d+\.?\d*",
    "r": r"r\s*=\s*-?0?\.\d+",
    "d": r"[Cc]ohen'?s\s*d\s*=\s*-?\d+\.?\d*",
    "r2": r"[Rr]\s*²\s*=\s*0?\.\d+|[Rr]2\s*=\s*0?\.\d+|(?i:rsquare)\s*=\s*0?\.\d+",
    "beta": r"[ΒBb]eta\s*=\s*-?\d+\.?\d*|[ΒBb]\s*=\s*-?\d+\.?\d*",
    "or": r"[Oo][Rr]\s*=\s*\d+\.?\d*|比值比\s*=\s*\d+\.?\d*",
    "alpha": r"(?i:Cronbach'?s?\s*(?:α|alpha))\s*=\s*0?\.\d+|[Aa]lpha\s*=\s*0?\.\d+|α\s*=\s*0?\.\d+",
    "mean": r"\bM\s*[=＝]\s*\d+\.?\d*|(?:均值|平均分|平均数|平均得分)\s*[=＝是为]\s*\d+\.?\d*",
    "sd": r"\bSD\s*[=＝]\s*\d+\.?\d*|(?i:\bS\.D\.)\s*[=＝]\s*\d+\.?\d*|(?:标准差|标准偏差)\s*[=＝是为]\s*\d+\.?\d*",
    "n": r"\b[nN]\s*[=＝]\s*" + _SIZE + r"|(?:样本量|样本数|有效样本|样本规模)\s*[=＝是为：:]?\s*" + _SIZE
         + r"|共\s*" + _SIZE + r"\s*[名人份个]|(?:抽取|选取|招募|纳入|入选|收集|随访)\s*了?\s*" + _SIZE + r"\s*[名人份个例]"
         + r"|有效\s*(?:问卷|样本|数据|被试)?\s*" + _SIZE + r"\s*[名人份个例]",
}
#: Every hit of a kind but ``n`` holds this once.  Without a long run of blanks or digits, its part before this is shorter than the first of
#: two lengths, and what decides on it after the sign is shorter than the second.
QUANTITY_SIGN = r"[<->≤≥＜-＞是为]\s*-?[0-9.]"
QUANTITY_LEAD, QUANTITY_TAIL, LONG_BLANK = 100, 60, r"[\s-]{10}|\d{10}"
#: The narrower forms of two kinds, as an optional rule set: sizes of two to five digits, and p only as ``=`` or as a
#: bound below .1.  They lose or shorten other numbers, so they are not the default.
NARROW_QUANTITY_PATTERNS = QUANTITY_PATTERNS | {
    "p": r"[Pp]\s*[<=]\s*0?\.0+\d+|[Pp]\s*=\s*0?\.\d+",
    "n": r"\b[nN]\s*[=＝]\s*\d{2,5}\b|(?:样本量|样本数|有效样本|样本规模)\s*[=＝是为：:]?\s*\d{2,5}"
         r"|共\s*\d{2,5}\s*[名人份个]|(?:抽取|选取|招募|纳入|入选|收集|随访)\s*了?\s*\d{2,5}\s*[名人份个例]"
         r"|有效\s*(?:问卷|样本|数据|被试)?\s*\d{2,5}\s*[名人份个例]",
}
SIGNIFICANCE_LEGEND = r"(?:\*{1,3}\s*[Pp]\s*[<≤=]\s*0?\.?\d+[,，;；、]?\s*){2,}"

# --- fixed values: abstract heads --------------------------------------------------------------
ABSTRACT_HEAD = r"摘\s{0,4}要|(?im:^\s*abstract\b)"
KEYWORD_HEAD = r"关\s{0,4}键\s{0,4}词|(?im:^\s*key\s?words\b)"
PAGE_NUMBER_LINE = r"^[\s　]{0,8}\n?[\s　]{0,8}(?:[IVXLCDM]{1,6}|\d{1,4})[\s　]*\n"
ABSTRACT_MIN, ABSTRACT_MAX = 80, 4000

# --- fixed values: cover-page markers, compared without blanks ---------------------------------
FRONT_MATTER_MARKERS = (
    "密级", "单位代码", "学校代码", "学号", "分类号", "中图分类号", "UDC", "论文题目", "论文提交日期",
    "论文答辩日期", "申请学位类别", "指导教师", "硕士学位论文", "博士学位论文", "研究生学位论文",
    "独创性声明", "学位论文使用授权", "本人完全了解", "ThesisSubmitted", "DissertationSubmitted",
    "SubmittedinPartial", "Thesisfor", "ThesisPresentedto", "Supervisor:", "Masterof", "Degreeof",
)
FRONT_MATTER_MAX, FRONT_MATTER_MAX_STRICT = 800, 2000

# --- fixed values: test statistics with degrees of freedom, and p-values -----------------------
_NUM = r"-?(?:\d+(?:\.\d+)?|\.\d+)"
_UNUM = r"(?:\d+(?:\.\d+)?|\.\d+)"
_PRE = r"(?<![A-Za-z0-9_])"
_DF = r"(?:df|DF|自由度|υ|ν)"
_CHI = r"(?:χ\s*\^?\s*2|(?<![A-Za-z0-9_])[xX]\s*\^?\s*2|[Cc]hi[\s-]*square[d]?)"
STATISTIC = "|".join((
    _PRE + r"[tT]\s*\(\s*\d+(?:\.\d+)?\s*\)\s*=\s*" + _NUM,
    _PRE + r"[tT]\s*=\s*" + _NUM + r"\s*[,;]?\s*" + _DF + r"\s*=\s*\d+(?:\.\d+)?(?!\s*,\s*\d)",
    _PRE + r"F\s*\(\s*\d+(?:\.\d+)?\s*[,/]\s*\d+(?:\.\d+)?\s*\)\s*=\s*" + _UNUM,
    _PRE + r"F\s*=\s*" + _UNUM + r"\s*[,;]?\s*" + _DF
    + r"\s*=\s*\(?\s*\d+(?:\.\d+)?\s*[,/]\s*\d+(?:\.\d+)?\s*\)?",
    _CHI + r"\s*\(\s*\d+\s*(?:,\s*[Nn]\s*=\s*\d+\s*)?\)\s*=\s*" + _UNUM,
    _CHI + r"\s*=\s*" + _UNUM + r"\s*[,;]?\s*" + _DF + r"\s*=\s*\d+",
    _PRE + r"r\s*\(\s*\d+\s*\)\s*=\s*" + _NUM,
    _PRE + r"r\s*=\s*" + _NUM + r"\s*[,;]?\s*[nN]\s*=\s*\d+",
    _PRE + r"[zZ]\s*=\s*" + _NUM,
))
P_VALUE = (
    r"(?<![A-Za-z])(?:[pP](?:\s*值)?|[Ss]ig\.?(?:\s*值)?|显著性(?!水平))\s*(?:均|都|皆)?\s*"
    r"(?:≤|≥|<=|>=|=|<|>|小于等于|大于等于|小于|大于|低于|高于|为|是)\s*"
    r"\d*\.?\d+(?:\s*[eE]\s*-?\s*\d+|\s*[×xX*]\s*10\s*\^?\s*-\s*\d+)?"
    r"(?![\d.]*\d)(?!\s*(?:[kKMG]?Pa|kW|W\b|Hz|mm|cm|km|kg|mol|℃|°|%))"
)
P_NOT_PVALUE_BEFORE = r"(?:概率|参数|系数|比例|比率|功率|压强|压力|取值|设|令|记)\s*$"
Z_CONTEXT = r"检验|显著|test|Mann|Whitney|Wilcoxon|秩和|Sobel|中介|(?<![A-Za-z])[UW]\s*="
RANK_CORRELATION = r"Spearman|Kendall|斯皮尔曼|肯德尔|等级相关|秩相关|ρ|τ"
MISSING_DF = _PRE + r"[tTF]\s*=\s*" + _NUM + r"\s*[,;]?\s*(?=[pP]\s*(?:值)?\s*[<=>≤≥])"
PAIR_GAP = 40

# --- fixed values: declared levels, tails, corrections and wording ------------------------------
ALLOWED_ALPHA = (0.1, 0.05, 0.01, 0.001)
ALPHA_DECLARATIONS = (
    r"显著性?水平\s*(?:设定?为|定为|取|为|=|α\s*=)?\s*(?:α\s*=\s*)?(0?\.\d+)",
    r"(?:以|按|取)\s*[pP]\s*(?:<|≤)\s*(0?\.\d+)\s*(?:为|作为|表示)",
    r"(?<![A-Za-z'’\s])α\s*=\s*(0?\.\d+)",
    r"(?i)significance level (?:of|was set (?:at|to)|=)\s*(0?\.\d+)",
)
SENTENCE_LEVEL_PERCENT = r"(\d+(?:\.\d+)?)\s*%\s*(?:的)?\s*(?:显著性)?\s*水平"
SENTENCE_LEVEL_DECIMAL = r"(0?\.\d+)\s*(?:的)?\s*(?:显著性)?\s*水平"
ONE_TAILED = r"单[侧尾]\s*(?:检验|[pP]|假设|t\s*检验)|(?i:one[\s-]*(?:tailed|sided)|directional\s+(?:test|hypothes))"
TWO_TAILED = (r"双[侧尾]\s*(?:(?:Student(?:['’]s)?|Welch)\s*)?(?:检验|[pP]|假设|t\s*检验)"
              r"|(?i:two[\s-]*(?:tailed|sided))")
TAIL_DENIED_BEFORE = (
    r"(?:不|未|没有|并未|从未|不再)(?:使用|采用|采取|进行|执行|应用|选择|设定|设置|考虑)?"
    r"(?:任何|预设的|事先的|额外的){0,2}\s{0,4}|(?i:\b(?:no|not|without|never)\b[^,;.!?\n。；，！？]{0,45})"
)
TAIL_DENIED_AFTER = (
    r"\s*(?:未|不|没有)(?:使用|采用|进行|应用)"
    r"|(?i:(?:\s+(?:tests?|hypotheses|hypothesis|p[\s-]*values?))?\s+"
    r"(?:(?:was|were|is|are|will be|have been|has been)\s+)?(?:not|never)\b)"
)
CORRECTION = (r"(?i)校正|矫正|Bonferroni|Holm|FDR|Tukey|LSD|Scheff|S-N-K|事后|多重比较|Greenhouse|Huynh|Welch"
              r"|Satterthwaite|稳健标准误|聚类标准误|robust")
QUESTION = r"是否|能否|有无|是不是|若|如果|假如|(?i:\bif\b|\bwhether\b)"
NOT_SIGNIFICANT = (
    r"(?:并不|均不|都不|尚不|尚未|未能|没有达到|未达到|未达|没有|未见|不|无|未|没)"
    r"\s*(?:统计学?上的?|统计学?)?\s*(?:的)?\s*(?:显著|统计学?意义)|差异不大|未见(?:明显)?差异|无差异"
    r"|(?i:\b(?:not|no|non|without)[\s-]+(?:statistically\s+)?significan(?:t|ce)|\binsignificant)"
)
SIGNIFICANT = (r"显著(?!性\s*(?:水平|检验|[=<>≤≥]|为)|水平)|有统计学?意义|差异有统计学"
               r"|(?i:\bsignificant(?:ly)?\b)")
MARGINAL = r"边缘显著|临界显著|接近显著|趋于显著|(?i:marginal)"

# --- fixed values: sample-size wording ----------------------------------------------------------
ITEM_QUANTIFIER = r"题项|条目|指标|维度|(?i:\bitems?\b)"
RECRUITED = r"招募|选取|征集|(?i:recruit)"
STUDY_WORDS = r"研究|调查|实验|分析|(?i:\bstud(?:y|ies)\b|survey|experiment)"
LARGE_SAMPLE_WORDS = r"纳入|调研|收集|共.*例|共.*名|(?i:enrolled|surveyed|collected)"

# --- fixed values: variable names ---------------------------------------------------------------
QUOTED_NAME = "[`\"“”'‘’《]([^`\"“”'‘’》\\n]{1,20})[`\"“”'‘’》]"
NAME_AFTER_KEYWORD = "(?:对|针对|考察|分析|检验|比较|在|关于)\\s*[\"“”'‘’《]?([^。；\\s,\"“”'‘’》]{1,20})[\"“”'‘’》]?"
NAME_NEAR_STATISTIC = "[\"“”'‘’《]([^。；\\s,\"“”'‘’》]{1,20})[\"“”'‘’》]\\s*(?:组|得分|成绩|分数|水平|指标|分)"
PHRASE_HEADS = (
    "研究", "本文", "本论文", "结果", "表明", "证明", "给出", "提出", "采用", "进行", "做出", "实现", "考虑",
    "存在", "满足", "保证", "需要", "具有", "仿真", "实验", "理论", "数据", "系统", "方法", "算法", "控制",
    "模型", "该", "其", "此", "它", "与", "和", "及", "或", "并", "从", "由", "将", "是", "为", "有", "可",
    "能", "会", "已", "被", "比", "更", "最", "上", "下", "中", "内", "外", "前", "后", "这", "那", "于",
    "同时", "然后", "因此", "以及", "但是", "然而", "随着", "通过", "根据", "基于", "利用", "使用", "借助",
    "依靠", "经过", "过去", "公司", "各个", "多种", "许多", "大量", "少数", "多数", "所有", "任何", "一定",
    "某种", "每个", "一次", "两次", "三是", "二是", "一是", "首先", "另外", "部分", "整体", "总体", "全文",
    "对于", "关于", "至于", "鉴于", "面对", "针对", "如下",
)
PHRASE_VERBS = (
    "进行", "做出", "给出", "提出", "表明", "证明", "实现", "考虑", "分析", "比较", "检验", "影响", "导致",
    "使得", "保证", "满足", "需要", "针对", "提升", "抑制", "跟踪", "经过", "属于", "等于", "位于", "来自",
    "构成", "成为", "作为", "称为", "有助于", "在于", "处于", "如下", "如上",
)
COMMON_VARIABLES = (
    "性别", "年龄", "年级", "专业", "班级", "学号", "成绩", "分数", "得分", "学习时长", "学习时间", "学习投入",
    "学习动机", "学习策略", "学习兴趣", "焦虑", "抑郁", "压力", "幸福感", "满意度", "自我效能", "实验组",
    "对照组", "前测", "后测", "干预组", "控制组", "父亲", "母亲", "独生", "生源地", "城乡",
)
VARIABLE_SYNONYMS = {
    "性别": ("gender", "sex", "男", "女"), "年龄": ("age",), "年级": ("grade", "year", "class"),
    "专业": ("major", "subject"), "班级": ("class", "班级"), "学号": ("id", "no", "num", "编号"),
    "成绩": ("score", "grade", "mark", "result", "分数", "得分"),
    "分数": ("score", "grade", "mark", "分数", "得分"), "得分": ("score", "grade", "mark", "分数", "得分"),
    "学习时长": ("study_hours", "study_time", "hours", "时间"),
    "学习时间": ("study_hours", "study_time", "hours", "时间"),
    "焦虑": ("anxiety",), "抑郁": ("depression",), "age": ("年龄",),
    "score": ("成绩", "分数", "得分", "grade"), "grade": ("成绩", "分数", "得分"),
    "study_hours": ("学习时长", "学习时间", "时间", "hours"), "study_time": ("学习时长", "学习时间"),
    "group": ("组", "分组"),
}

# --- fixed values: table headers ----------------------------------------------------------------
PERCENT_HEADER = r"(?i)百分比|占比|比例|百分率|构成比|相对频|percent|pct|%"
COUNT_HEADER = (r"(?i)频数|频次|次数|人数|例数|个案数|数量|个数|样本数|样本量|count|freq|number"
                r"|(?<![A-Za-z0-9])n(?![A-Za-z0-9])")
DESIGN_HEADER = (r"(?i)序号|编号|编码|组别|分组|年份|时间|剂量|浓度|梯度|水平|温度|重复"
                 r"|(?<![A-Za-z0-9])(?:id|no|index|year|time|dose|conc|level)(?![A-Za-z0-9])")
TOTAL_LABEL = r"(?i)合计|总计|总数|总和|总额|小计|total|sum"
N_CELL = r"^(?:n|N|例数|人数|样本量|样本数|被试数|受试者)$|^[nN][=：:]"
MEAN_CELL_HEADER = r"(?i)均值|平均|平均分|M\b|mean"
MEAN_HEADERS = ("m", "mean", "均值", "平均值", "平均数", "平均分", "平均")
SD_HEADERS = ("sd", "s.d.", "std", "标准差", "标准偏差", "标准差sd")
N_HEADERS = ("n", "样本量", "样本数", "样本容量", "人数", "例数", "被试数")
SKIP_HEADERS = ("作者", "年份", "文献", "来源", "期刊", "序号", "编号")
NUMBER_CELL = r"^-?\d+(?:,\d{3})*(?:\.\d+)?%?$"
MERGED_CELL = r"^(-?\d+(?:\.\d+)?)\s*[±(（]\s*(-?\d+(?:\.\d+)?)\s*[)）]?$"
MEAN_SD_CELL = r"(\d+(?:\.\d+)?)\s*±\s*(\d+(?:\.\d+)?)"
