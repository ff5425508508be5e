"""Fixed values for integrity and style checks of texts, as plain text.

Operators take these lists as parameters; ``StyleRules`` bundles the ones of one language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CJK = "一-鿿"

# --- fixed values: sections and references ------------------------------------------------------
REFERENCE_HEAD = (
    r"(?m)^[ \t]*(?:[一二三四五六七八九十]+[、.]|\d+(?:\.\d+)*[ \t]*|第[一二三四五六七八九十\d]+[章节部分][ \t]*)?"
    r"(?:参[ \t]*考[ \t]*文[ \t]*献|主要参考文献|引用文献|References|REFERENCES|Bibliography)[ \t]*[:：]?[ \t]*$"
)
TAIL_HEAD = (
    r"(?m)^[ \t]*(?:致[ \t]*谢|谢[ \t]*辞|后[ \t]*记|附[ \t]*录|作者简介|个人简历|攻读.{0,12}(?:期间|成果)"
    r"|Acknowledg(?:e)?ments?|Appendix)[^\n]{0,30}$"
)
FIRST_ENTRY = r"(?m)^[ \t]*(?:\[\s*1\s*\]|1[.、])|\[(?:J|M|D|C|EB/OL)\]"
PAGE_NOISE = r"^\s*(?:\d{1,3}|参\s*考\s*文\s*献|万方数据|References)\s*$"
TABLE_ROW = " | "
CONTENTS_LINE = r"(?:[.…·]{3,}|\t)[ \t]*\d{1,3}[ \t]*$"
ENTRY_BRACKET = r"(?m)^[^\S\n]*[\[［](\d{1,3})[\]］][^\S\n]*(?=\S)"
#: A bracketed number inside a line, after the end of a sentence or another bracket.
ENTRY_INLINE = r"([.。\]］]\s*)([\[［]\s*(\d{1,3})\s*[\]］][^\S\n]*)(?=\S)"
ENTRY_DOTTED = r"(?m)^[^\S\n]*(\d{1,3})[.．、][^\S\n]*(?=[^\d\s])"
TYPE_CODE = r"\[\s*(J|M|D|C|N|R|S|P|G|Z|A|K|CM|DS|DB|CP|EB)(?:\s*/\s*(OL|MT|DK|CD))?\s*\]"
YEAR = r"(?<!\d)(1[89]\d{2}|20\d{2})(?!\d)"
JOURNAL_VOLUME = (
    r"(?:1[89]|20)\d{2}\s*(?:[,，]\s*(?:No\.?\s*)?\d+\s*(?:[(（]\s*[\dA-Za-z\-/ ]{1,20}\s*[)）])?"
    r"|[,，]?\s*[(（]\s*[\dA-Za-z\-/ ]{1,20}\s*[)）])"
)
PAGES = (
    r"[:：]\s*[A-Za-z]?\d+(?:\s*[-–—~]\s*[A-Za-z]?\d+)?(?:\s*[,，]\s*\d+(?:\s*[-–—~]\s*\d+)?)*"
    r"|(?:1[89]|20)\d{2}\s*[,，]\s*\d+\s*[-–—~]\s*\d+\s*[.。]?\s*$|[)）]\s*[,，]\s*[A-Za-z]?\d{2,}"
)
PUBLISHER = r"[:：]\s*[^,，:：.。\[\]]{2,40}[,，]\s*(?:1[89]|20)\d{2}"
URL = r"(?i)https?://|www\.|doi\s*[:：]|\b10\.\d{4,9}/"
CITE_DATE = r"\[\s*(?:19|20)\d{2}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2}\s*\]"
PERSON_NAME = (r"[一-鿿·]{2,6}|[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+)*\s+[A-Z]{1,3}(?:\s*[A-Z])?")
ET_AL = r"(?i)(?:等|et\s*al\.?|etc\.?)\s*$"

# --- fixed values: citations --------------------------------------------------------------------
CITATION = (r"\[(?<![0-9_]\[)(?<!(?<![A-Za-z])[a-z]\[)(?<!(?<![A-Za-z])[a-z]{2}\[)"
            r"(?<!(?:区间|范围|取值|∈|矩阵|数组|向量|索引)\s{0,4}\[)"
            r"\s*(\d{1,3}(?:\s*[-,~]\s*\d{1,3})*)\s*\](?!\s*(?:区间|范围|之间))")
AUTHOR_YEAR_GROUP = r"\(([^()\n]{2,120}?)\)"
AUTHOR_YEAR = (r"^\s*([一-鿿·]{2,12}?|[A-Z][A-Za-z'\-]+)(?:等人?|\s+(?:and|&)\s+[A-Z][A-Za-z'\-]+|\s+et\s+al\.?)?"
               r"\s*,?\s*((?:1[89]|20)\d{2})[a-z]?\s*$")

# --- fixed values: captions and mentions --------------------------------------------------------
CAPTION = (r"(?m)^[ \t]*({words})[ \t]*(\d{{1,2}}(?:[.\-]\d{{1,2}}){{0,2}})(?![\d.\-])[ \t:]*([^\n]{{0,120}})$")
FIGURE_WORDS = r"图|Figure|Fig\."
TABLE_WORDS = r"表|Table"
NOT_CAPTION = (
    r"^(?:所示|中[,，的可所]|中$|可知|可以|可见|表明|说明了?[,，]|显示|反映了|给出了|列出了|为[,，]|是[,，]"
    r"|和[图表]|与[图表]|及[图表]|至|~|-|、|,|的[结数]|展示了|描述了|对比|进一步|则|结果(?:可知|表明|显示)"
    r"|(?i:shows?\b|presents?\b|lists?\b|reports?\b|and\b))"
)
MENTION = (r"(?:{words})(?<![[一-鿿A-Za-z]&&[^如见由据按参从在将对把至到即详依和与及、上下的]](?:{words}))[ \t]*"
           r"(\d{{1,2}}(?:[.\-]\d{{1,2}}){{0,2}})(?!\d|[.\-]\d)")

# --- fixed values: typography and structure -----------------------------------------------------
TYPOGRAPHY = (
    ("half_width_punctuation", r"[一-鿿][,;:?!][一-鿿]"),
    ("half_width_brackets", r"\([一-鿿][^()\n]{0,40}\)"),
    ("repeated_punctuation", r"([，。、；：])\1+"),
    ("ellipsis", r"(?<=[一-鿿])(?:\.{3,}|。。。|…(?!…))"),
    ("full_width_digits", r"[０-９]+"),
    ("blank_between_characters", r"[一-鿿][ \u3000]+[一-鿿]"),
)
PAIRS = (("（", "）"), ("“", "”"), ("‘", "’"), ("《", "》"), ("【", "】"))
SKIP_LINE = r"(?i)^\s*(?:关键词|关键字|Key\s*words?|摘\s*要|目\s*录|第.{1,3}章)"
ABSTRACT_CN = r"(?m)^[ \t]*[\[【]?\s*摘[ \t]*要\s*[\]】]?"
ABSTRACT_EN = r"(?m)^[ \t]*(?:\[|【)?\s*(?:Abstract|ABSTRACT)\b"
KEYWORD_LINE = r"(?m)^[ \t]*[\[【]?\s*(?:关键[词字]|Key\s?words)\s*[\]】]?\s*[:：]?\s*([^\n]+)"
CHAPTER = r"(?m)^[ \t]*(?:第[ \t]*([一二三四五六七八九十]{1,3}|\d{1,2})[ \t]*章(?=[ \t]*\S)|Chapter[ \t]+(\d{1,2}))[^\n]{0,40}$"

# --- fixed values: coherence --------------------------------------------------------------------
CORRELATIONAL_METHODS = ("correlation", "spearman", "cronbach_alpha", "regression",
                         "linear_regression", "logistic_regression")
EXPERIMENTAL_METHODS = ("independent_t", "paired_t", "one_sample_t", "anova", "two_way_anova",
                        "repeated_measures_anova", "mann_whitney", "wilcoxon", "kruskal_wallis")
CAUSAL_VERB = (r"(?:导致|引起|引发|致使|造成|促进|提升了|提高了|降低|减少|改善|抑制|增强)(?![性力率度者物])"
               r"|(?i:\b(?:causes?|caused|leads? to|led to|results? in|resulted in)\b)")
CAUSAL_SKIP = (r"(?:假设|推测|猜想|据|文献|前人|已有研究|研究者|既往|相关研究|若|如果|可能|也许|或许|有望"
               r"|(?i:\b(?:may|might|could|hypothes\w*|previous|if)\b))")
HYPOTHESIS_HEAD = r"^(?:假[设说]|[Hh])\s*"
HYPOTHESIS = (r"假[设说]\s*([0-9]{1,2}|[一二三四五六七八九十]{1,3})(?!\s*[个种类条次项名位组部分])"
              r"|[Hh](?<![A-Za-z][Hh])\s*([0-9]{1,2})(?![A-Za-z0-9])")

# --- fixed values: style, Chinese ---------------------------------------------------------------
CONNECTIVES_ZH = (
    "综上所述", "综合上述", "进一步", "此外", "与此同时", "值得注意的是", "可以看出", "由此可见",
    "一般来说", "不仅如此", "所以说", "因此可见", "不得不说", "需要指出的是", "不容否认",
    "毋庸置疑", "不言而喻", "众所周知", "相比之下",
)
HYPE_ZH = ("显著提高", "显著提升", "显著增强", "显著改善", "大幅提高", "大幅提升", "大幅降低", "有效解决",
           "完美实现", "取得显著成果", "极大提高", "极具潜力", "无与伦比", "至关重要")
RESIDUE_ZH = (
    r"作为一个?AI", r"作为人工智能", r"好的[，,]以下是", r"以下是?(?:我|为您)(?:整理|撰写|生成|编写)",
    r"希望(?:这|以上|以下)(?:对您|能|些)", r"如果(?:您|你)(?:需要|还有|想)", r"抱歉[，,]我",
    r"（?注：?以上内容由", r"本(?:回答|回复|内容)由(?:AI|人工智能)",
)
REDLIST_ZH = (
    r"(?<![A-Za-z0-9])LSTM(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])CNN(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])RNN(?![A-Za-z0-9])", r"深度神经网络|(?<![A-Za-z0-9])DNN(?![A-Za-z0-9])",
    r"[Tt]ransformer|注意力机制", r"强化学习", r"遗传算法|(?<![A-Za-z0-9])GA(?![A-Za-z0-9])算法",
    r"蚁群(?:算法)?", r"粒子群|(?<![A-Za-z0-9])PSO(?![A-Za-z0-9])",
    r"支持向量机|(?<![A-Za-z0-9])SVM(?![A-Za-z0-9])", r"随机森林", r"XGBoost|LightGBM",
)
GENERIC_ZH = (r"广泛应用于", r"适用范围广", r"适用范围很广", r"可推广到各个", r"普适性强",
              r"在任何.{0,6}(?:领域|场景)(?:都|均)")
PASSIVE_ZH = r"被|为[^，。；！？\n]{1,12}所|得以"
NUMBER_AFTER = r"(?i)[0-9０-９%％]|[mpn]\s*="
JUSTIFICATION = r"因为|由于|适用|适合|本题|该题|原因|缘于|(?i:because|suited|suitable)"
METHOD_MARK = ("被试|实验程序|实验流程|实验设计|数据处理|数据收集|问卷|测量|测度|SPSS|Stata|描述性统计|回归分析"
               "|方差分析|信度|效度|均值|反应时|注视|随机分配|随机抽取|样本选取|平衡性检验"
               "|(?i:participants|procedure|questionnaire|measured)")
QUOTED_SPAN = "“[^”]{8,}”|「[^」]{8,}」|『[^』]{8,}』"
STYLE_REFERENCES = r"(?m)^\s*(?:参考文献|References|REFERENCES)\s*$"
COVER_FAMILIES = (
    r"密\s*级", r"学\s*号", r"分\s*类\s*号|中图分类号|UDC", r"(?:单\s*位|学\s*校)\s*代\s*码",
    r"[硕博]\s*士\s*学\s*位\s*论\s*文|学位论文", r"学位申请人|作者姓名|指导教师|导\s*师",
    r"学\s*科\s*专\s*业|研究方向|培养单位|申请学位类别",
    r"答辩日期|论文提交日期|学习年限|二〇[一二三四五六七八九〇]{2}\s*年",
    r"(?i)A\s+(?:Dissertation|Thesis)\s+Submitted|in\s+Partial\s+Fulfil",
)
COVER_MIN_FAMILIES = 3
REFERENCE_ENTRY = r"(?m)^\s*\[\d+\]\s*\S|\[\s*[JMCDNP]\s*\]\s*[\.．]|etal\."
SENTENCE_CLOSERS = "[。！？.!?」』”）)】]$"
QUOTE_PAIRS = (("「", "」"), ("『", "』"), ("“", "”"))

# --- fixed values: draft gate, red lines, secrets ------------------------------------------------
PRAISE_WORDS = (
    "significant", "substantial", "strong", "robust", "effective", "promising", "remarkable", "novel",
    "comprehensive", "state-of-the-art", "显著", "重要", "强大", "稳健", "有效", "有前景", "卓越", "新颖",
    "全面", "领先",
)
VAGUE_PHRASES = (
    "shows advantages", "performs well", "works effectively", "achieves competitive results",
    "delivers better performance", "improves overall quality", "demonstrates robustness",
    "has broad applicability", "表现良好", "效果显著", "具有优势", "性能优异", "有较好表现", "提升了整体质量",
)
RESULT_METHOD = r"(?i)T\s*检验|方差分析|相关分析|卡方检验|回归分析|信度分析|两因素|双因素|t[\s-]*test|ANOVA|regression"
RESULT_NUMBER = r"[=＝]\s*[-−]?\d"
RESULT_STATISTIC = r"t\s*=|F\s*=|χ²|r\s*=|R²|α\s*=|p\s*[<=＝]|t\(\d+\)\s*="
RED_LINES = (
    ("core", r"代写|代笔|枪手|替写|找人写|代人写|请写手|代做|包写"),
    ("core", r"(?:买|卖|购买|出售|收购|定制|求购).{0,6}(?:论文|毕设|毕业论文|学位论文|作业|文稿)"
             r"|(?:论文|毕设|毕业论文).{0,4}(?:交易|买卖|代做|包过)"),
    ("core", r"(?:绕过|躲过|规避|逃避|骗过|逃过|避开).{0,8}(?:查重|重复率|知网|维普|万方|turnitin|相似度)"
             r"|降重|(?:重复率|查重率|相似度).{0,4}(?:降|改|压|做)"),
    ("core", r"(?:去除|去掉|消除|洗掉|洗去|降低|伪装|隐藏).{0,8}(?:aigc|ai|人工智能).{0,6}(?:痕迹|味|率|检测|特征|标记)"
             r"|(?:绕过|躲过|骗过|规避|逃避).{0,8}(?:aigc|ai).{0,6}(?:检测|审查|识别)"
             r"|(?:aigc|ai).{0,4}(?:降重|去痕|洗稿)"),
    ("core", r"(?:伪造|编造|造假|捏造|杜撰|篡改|瞎编|乱编|凑).{0,8}"
             r"(?:数据|结果|样本|问卷|实验结果|统计量|统计结果|p\s*值|显著性)|(?:数据|结果|样本).{0,4}(?:造假|掺水|动手脚)"
             r"|(?:把|将).{0,6}(?:数据|结果|p\s*值).{0,6}(?:改|调).{0,4}(?:大|小|高|低|到|成)"),
    ("writing", r"(?:帮我|替我|给我|请|帮).{0,6}(?:写|生成|产出一?篇?|来一?篇?).{0,6}(?:整段|整篇|全文|完整|一篇).{0,8}"
                r"(?:讨论|discussion|结论|摘要|正文|章节|论文|文章|报告)?"),
    ("writing", r"(?:帮我|替我|给我|请).{0,6}(?:写|生成).{0,4}(?:一篇|一整篇|完整的).{0,4}(?:论文|文章|毕设|毕业论文|报告)"),
)
SAFE_INTENT = (r"润色|改.{0,3}语病|改.{0,3}语法|修改.{0,3}语病|调整.{0,3}结构|优化.{0,3}表达|翻译|校对|检查.{0,3}格式|缩写"
               r"|精简|帮我看看|帮我检查|这样写.{0,3}(?:对吗|对不对)|是否合理|有没有问题")
KEY_SHAPE = r"\bsk-[A-Za-z0-9_\-]{16,}"
LONG_RUN = r"[A-Za-z0-9]{20,}"
ACCOUNT_SHAPE = r"\b(?:org-[0-9a-f]{8,}|ak-[0-9a-z]{8,})"
EMAIL_SHAPE = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@dataclass(frozen=True)
class StyleRules:
    """Word lists of one language for the style metrics."""

    sentence_end: str
    min_letters: tuple[str, int]
    connectives: tuple[str, ...]
    passive: str
    hype: tuple[str, ...]
    residue: tuple[str, ...]
    redlist: tuple[str, ...]
    generic: tuple[str, ...]
    phrases: tuple[tuple[str, str], ...] = field(default=())
    token: str = ""

    @property
    def connective_pattern(self) -> str:
        return "|".join(self.connectives)


def chinese_style() -> StyleRules:
    from plumbline.functions.phrase_rules import PHRASE_RULES
    return StyleRules(
        sentence_end=r"[。！？；\n]+", min_letters=(f"[{CJK}]", 4), connectives=CONNECTIVES_ZH,
        passive=PASSIVE_ZH, hype=HYPE_ZH, residue=RESIDUE_ZH, redlist=REDLIST_ZH,
        generic=GENERIC_ZH, phrases=PHRASE_RULES, token=f"[{CJK}]")


#: Latin-script companion, written for this library.
ENGLISH_STYLE = StyleRules(
    sentence_end=r"[.!?;\n]+", min_letters=(r"[A-Za-z]", 4),
    connectives=(r"\bin summary\b", r"\bfurthermore\b", r"\bmoreover\b", r"\bin addition\b",
                 r"\bit is worth noting\b", r"\bas can be seen\b", r"\bin general\b",
                 r"\bneedless to say\b", r"\bas is well known\b", r"\bin contrast\b"),
    passive=r"\b(?:is|are|was|were|been|being|be) \w+ed\b",
    hype=(r"significantly improved?", r"greatly improved?", r"perfectly solved?", "unparalleled",
          "crucially important", "enormous potential"),
    residue=(r"[Aa]s an AI", r"[Hh]ere is the (?:text|essay|paper)", r"I hope this helps",
             r"[Ll]et me know if you"),
    redlist=(r"\bLSTM\b", r"\bCNN\b", r"\bRNN\b", r"\bDNN\b", r"[Tt]ransformer", r"reinforcement learning",
             r"genetic algorithm", r"ant colony", r"particle swarm", r"\bSVM\b", r"random forest",
             r"XGBoost|LightGBM"),
    generic=(r"widely applicable", r"can be applied to any", r"in any (?:field|scenario)"),
    phrases=(("empty_summary", r"of great significance"), ("empty_summary", r"laid a solid foundation"),
             ("cliche", r"in today's (?:society|world)"), ("cliche", r"needless to say"),
             ("inflation", r"plays an? (?:vital|crucial|pivotal) role"),
             ("certainty", r"without (?:a )?doubt"), ("attribution", r"studies have shown"),
             ("dash", r"—[^—\n]{1,200}?—")),
    token=r"[A-Za-zÀ-ÿ]+",
)
