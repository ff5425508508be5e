"""Word lists and thresholds that results depend on, as plain text.

Every operator that uses one of these lists takes it as a parameter, so another vocabulary can be
passed in.
"""

# --- fixed values: column-name tokens -------------------------------------------------------
TOTAL_TOKENS = ("总", "合计", "总计", "总额", "总分", "总和", "综合", "total", "sum", "overall")
COUNT_TOKENS = ("人数", "个数", "次数", "数量", "频数", "数目", "样本", "count", "num", "size")
ID_TOKENS = ("id", "no", "编号", "学号", "num", "序号", "name")
ROW_ID_TOKENS = ("id", "编号", "学号", "序号", "no", "name")
NOT_SCALE_TOKENS = (
    "年级", "班级", "组别", "分组", "编号", "序号", "学号", "被试", "id", "no", "num", "class",
    "group", "level", "性别", "sex", "gender", "第几", "次序", "排序",
)
DURATION_TOKENS = ("时长", "用时", "耗时", "duration", "time")
REACTION_TOKENS = ("反应", "reaction")
BENFORD_SKIP_TOKENS = (
    "id", "编号", "学号", "工号", "编码", "序号", "流水", "电话", "手机", "邮编", "身份证", "卡号",
    "年", "月", "日", "year", "month", "day", "date", "日期", "学期", "届",
    "likert", "量表", "评分", "得分", "score", "等级", "评级", "rank", "排名", "名次", "满意度",
    "百分比", "percent", "pct", "比例", "rate", "率",
    "价格", "金额", "price", "cost", "fee", "费用",
)
TERMINAL_SKIP_TOKENS = (
    "id", "编号", "学号", "工号", "编码", "序号", "流水", "电话", "手机", "邮编", "身份证", "卡号",
    "年份", "year", "年",
)

# --- fixed values: range rules by column name (tokens, low, high, label); None = unbounded ----
RANGE_RULES = (
    (("成绩", "分数", "得分", "考分", "分值", "score", "grade", "mark"), 0.0, 100.0, "score"),
    (("年龄", "age"), 0.0, 120.0, "age"),
    (("百分比", "占比", "比例", "percent", "pct"), 0.0, 100.0, "percent"),
    (("人数", "个数", "次数", "数量", "频数", "样本", "count"), 0.0, None, "count"),
)

# --- fixed values: pre/post markers, longest first -------------------------------------------
PRE_TOKENS = ("前测", "前", "pretest", "pre", "t1", "_1")
POST_TOKENS = ("后测", "后", "posttest", "post", "t2", "_2")
MEASURE_WORDS = ("成绩", "得分", "分数", "数值", "变量", "指标")

# --- fixed values: designs claimed by a method ------------------------------------------------
PAIRED_METHODS = ("paired_t", "wilcoxon", "repeated_measures_anova")
GROUP_METHODS = ("independent_t", "anova", "mann_whitney")

# --- fixed values: thresholds -----------------------------------------------------------------
SCALE_LOW, SCALE_HIGH = 1, 7
BENFORD_MAD_LIMIT = 0.015
BENFORD_BANDS = ((0.006, "close"), (0.012, "acceptable"), (0.015, "marginal"))
CHI2_9_P001 = 27.877164871256568  # upper 0.1 % point of chi-square with 9 degrees of freedom
TERMINAL_SHARE_LIMIT = 0.25
