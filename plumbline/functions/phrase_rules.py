"""Phrase rules for writing style: (class, pattern), as plain text.

Operators take a rule list as a parameter; these are the fixed values for Chinese texts.
"""

# --- fixed values: phrase rules -----------------------------------------------------------------
PHRASE_RULES = (
    ("空泛总结", r"具有重要意义"),
    ("空泛总结", r"具有(较高|重要)的?(学术|理论|实践|应用)?价值"),
    ("空泛总结", r"提供了?(有力|坚实|重要)的?(支撑|依据|基础|保障)"),
    ("空泛总结", r"奠定了?(坚实|良好|重要)的?基础"),
    ("空泛总结", r"(为|对)(后续|未来|进一步)(的)?(研究|工作|实践)(提供|奠定|指明)"),
    ("空泛总结", r"综上所述[，,]"),
    ("空泛总结", r"总体(来看|而言)[，,]"),
    ("空泛总结", r"具有(广阔|良好|光明)的(应用|发展|推广)前景"),
    ("空泛总结", r"取得了?(显著|丰硕|良好|可喜)的?(成果|成效|进展|成绩)"),
    ("空泛总结", r"(丰富|拓展|补充)了.{0,12}(理论|研究|文献|成果)"),
    ("空泛总结", r"(填补|弥补)了.{0,12}(空白|不足|缺口)"),
    ("空泛总结", r"有待(进一步|深入|后续)(研究|探讨|探索|验证)"),
    ("空泛总结", r"仍有(很大|较大|广阔)的?研究空间"),
    ("空泛总结", r"提供了?新的(思路|视角|方向|路径)"),
    ("空泛总结", r"(值得|有待)(我们)?(深入|进一步)(思考|研究|探讨)"),
    ("空泛总结", r"(做出了?|作出)(重要|突出|应有)的?贡献"),
    ("空泛总结", r"具有(一定|较高)的?(推广|参考|借鉴|指导)(价值|意义)"),
    ("空泛总结", r"(开启|开辟)了(新|崭新的)(篇章|局面|途径|路径)"),
    ("空泛总结", r"在.{2,10}(层面|角度)(上)?(均|都|也)(有所|具有).{0,8}"),
    ("空泛总结", r"(不断|持续)(提升|优化|完善)(自我|能力|水平)[，,]?"),
    ("套话", r"不难(看出|发现)|显而易见|众所周知"),
    ("套话", r"值得注意的是[，,]?"),
    ("套话", r"需要(特别)?指出的是"),
    ("套话", r"不容(忽视|否认)的是"),
    ("套话", r"不可否认的是"),
    ("套话", r"毋庸置疑|无可置疑"),
    ("套话", r"由此可见[，,]?"),
    ("套话", r"由此(可以)?(看出|推断|判断|得知)"),
    ("套话", r"(正)?如前(文|述)所述"),
    ("套话", r"简而(言之|论之)|一言以蔽之"),
    ("套话", r"归根结底|说到底"),
    ("套话", r"换言之|换句话说"),
    ("套话", r"诚然[，,]"),
    ("套话", r"值得一提的是[，,]?"),
    ("排比堆砌", r"(高效|准确|稳定|可靠|全面|系统|科学)(、|\s*,\s*)?(高效|准确|稳定|可靠|全面|系统|科学)(、|\s*,\s*)?(高效|准确|稳定|可靠|全面|系统|科学)"),
    ("排比堆砌", r"具有(很强|很强|极强|突出)的"),
    ("排比堆砌", r"不仅.{2,20}而且.{2,20}更"),
    ("排比堆砌", r"既.{2,15}[，,]?又.{2,15}[，,]?还"),
    ("排比堆砌", r"一方面.{2,30}另一方面.{2,30}(总的来说|总之|总体而言)"),
    ("排比堆砌", r"无论是.{2,15}还是.{2,15}(都|均)"),
    ("排比堆砌", r"(重要|关键|核心)(、|和|与)(重要|关键|核心)(、|和|与)?"),
    ("排比堆砌", r"从.{2,10}到.{2,10}再到.{2,10}"),
    ("排比堆砌", r"(推动|促进|助力|赋能).{0,8}(、|和|与|及).{0,8}(推动|促进|助力|赋能)"),
    ("排比堆砌", r"(深度|全面|系统)地?(融合|结合|衔接|协同)[，,]?"),
    ("长句套式", r"不仅.{0,20}而且"),
    ("长句套式", r"在.{0,15}的?(基础|前提)上[，,]?\s*(进一步|进而)"),
    ("长句套式", r"随着.{0,20}的?(不断|持续)(发展|深入|推进)"),
    ("长句套式", r"旨在|致力于"),
    ("长句套式", r"随着.{0,15}(的)?(兴起|普及|推广|广泛应用)"),
    ("长句套式", r"在当今.{0,12}(时代|社会|背景)下?"),
    ("长句套式", r"(基于此|鉴于此|有鉴于此)[，,]?"),
    ("长句套式", r"基于上述(考虑|分析|原因|背景)"),
    ("长句套式", r"(本文|本研究)(首先|其次|最后|再次)[，,]?"),
    ("长句套式", r"本文(旨在|试图|尝试|拟)"),
    ("长句套式", r"以期|以望|以求"),
    ("长句套式", r"在(?!.{0,6}(老师|导师|教授|先生|课题组|团队|基金|项目)).{0,12}的(指导|引领|支撑|推动|带动)下"),
    ("长句套式", r"为了(更好|有效)地.{0,12}[，,].{0,20}(本文|本研究)"),
    ("长句套式", r"从.{2,12}(的角度|视角|层面)(出发|来看|入手)"),
    ("互联网黑话", r"赋能|抓手|闭环打?通|生态化"),
    ("互联网黑话", r"全链路|全流程闭环"),
    ("互联网黑话", r"提质增效"),
    ("互联网黑话", r"双轮驱动|多轮驱动"),
    ("互联网黑话", r"组合拳|打法|穿透力"),
    ("互联网黑话", r"(打造|构筑)(出)?新?的?(生态|格局|高地|引擎)"),
    ("互联网黑话", r"(极大|大大)(地)?(提升|改善|促进|增强)"),
    ("互联网黑话", r"(深度|有机)(融合|结合)(在)?一起"),
    ("互联网黑话", r"(痛点|痒点|燃点|爆点)"),
    ("互联网黑话", r"精准(赋能|滴灌|施策)"),
    ("互联网黑话", r"数字化(转型|升级)"),
    ("互联网黑话", r"为新?时代.{0,10}(注入|增添)(新)?活力"),
    ("情绪词", r"(令人|值得)(惊讶|欣喜|振奋)的是"),
    ("情绪词", r"非常(重要|关键|显著)|极为(重要|关键)"),
    ("情绪词", r"(令|让)人?(欣慰|满意|遗憾|担忧|深思)的是"),
    ("情绪词", r"可喜的是|令人遗憾的是|可惜的是"),
    ("情绪词", r"极大地?(震撼|触动|鼓舞)"),
    ("情绪词", r"(振奋人心|催人奋进|意义非凡)"),
    ("重要性膨胀", r"至关(重要|关键)"),
    ("重要性膨胀", r"不可或缺"),
    ("重要性膨胀", r"举足轻重"),
    ("重要性膨胀", r"(意义|影响)(重大|深远|非凡)"),
    ("重要性膨胀", r"(产生|具有|带来)深远(的)?影响"),
    ("重要性膨胀", r"(引起|引发|受到)广泛(的)?(关注|重视|认可)"),
    ("重要性膨胀", r"(高度|广泛)(重视|契合|关注|认可)"),
    ("重要性膨胀", r"(起着|发挥着)(重要|关键|不可替代|举足轻重)的?作用"),
    ("重要性膨胀", r"不可(忽视|小觑|低估)"),
    ("重要性膨胀", r"标志着"),
    ("重要性膨胀", r"(具有|具备)(独特|鲜明|显著)的?(优势|特色|特征)"),
    ("重要性膨胀", r"(开创性|突破性|颠覆性)(的)?(研究|成果|进展)"),
    ("重要性膨胀", r"意义(深远|重大)"),
    ("重要性膨胀", r"(在|于)学术(界|领域)(产生|引发)(了)?(广泛)?(影响|反响)"),
    ("数据描述模板", r"从(表|图)(中|里)?(可以)?(看出|看出|看到|观察)"),
    ("数据描述模板", r"由(表|图)(中)?(可以)?(看出|可知|得知)"),
    ("数据描述模板", r"如(表|图)(中)?(所示|可见)"),
    ("数据描述模板", r"(数据显示|数据表明)"),
    ("数据描述模板", r"研究(发现|表明|显示)(?![^。！？\n]{0,25}\[[^\]]{0,12}\])[，,]?"),
    ("数据描述模板", r"(?<![一-鿿])(统计分析?|分析)(结果|数据)?(显示|表明)"),
    ("数据描述模板", r"实验(结果)?(表明|显示)"),
    ("数据描述模板", r"上述(结果|数据|分析)(表明|说明|显示)"),
    ("数据描述模板", r"(从|由)(上述|以上)(分析|结果|数据)(可以)?(看出|可见|得知)"),
    ("过度确定性", r"(毫无|没有)(疑问|悬念|例外)"),
    ("过度确定性", r"必然(会|将|是)"),
    ("过度确定性", r"势必(会|将)?"),
    ("过度确定性", r"必将"),
    ("过度确定性", r"无一例外"),
    ("过度确定性", r"(必定|一定)(会|能)"),
    ("过度确定性", r"(充分|完全)(证明|说明|表明)"),
    ("过度确定性", r"(绝对|完全)(可以|能够)?(保证|确保)"),
    ("模糊归因", r"(?:有(?:研究|学者|专家|研究者)|相关(?:研究|文献)|大量(?:研究|文献)|部分(?:研究|学者))(?:表明|认为|指出|发现|提出)(?![^。！？\n]{0,25}\[[^\]]{0,12}\])"),
    ("模糊归因", r"(学界|业内)(普遍)?(认为|公认|共识)"),
    ("模糊归因", r"普遍(认为|觉得|观点)"),
    ("模糊归因", r"(人们|大家)(普遍)?(认为|觉得)"),
    ("模糊归因", r"据(统计|报道|了解|悉)[，,]?"),
    ("系词回避", r"扮演着.{1,12}的?角色"),
    ("系词回避", r"(起着|起到)(了)?.{1,10}的?作用"),
    ("系词回避", r"作为.{1,12}的代表"),
    ("系词回避", r"成为.{1,12}(的)?(重要)?组成部分"),
    ("公式化局限段", r"(由于|受).{0,10}(时间|篇幅|条件|能力|精力|数据)(和|与|、)?(的)?(限制|有限|不足)"),
    ("公式化局限段", r"本研究(仍|还|也)?(存在|有)(一些|一定的|诸多)?(局限|不足|欠缺)"),
    ("公式化局限段", r"未来(的)?研究(可以|可|有?待)(进一步|继续)"),
    ("公式化局限段", r"(有待|尚待)(今后|后续|未来)(进一步)?"),
    ("公式化局限段", r"(希望|期望)本文(能)?(为|对)"),
    ("口语网络", r"yyds|绝绝子|破防|社死|摆烂|翻车|封神|硬核|离谱|逆天|炸裂|整活|拿捏|有梗"),
    ("口语网络", r"(说实话|坦白讲|老实说|说白了|不瞒你说|讲真)"),
    ("口语网络", r"(反正|大概齐|差不多就是|这事儿|这事的|说到底就是)"),
    ("口语网络", r"(搞定|踩坑|手感|无缝衔接)"),
    ("口语网络", r"(很|挺|特)(不错|好用|方便|厉害)的?"),
    ("口语网络", r"(一言难尽|不服不行|真香)"),
    ("破折号超标", r"——[^—\n]{1,200}?——(?![一-鿿]{1,6}(?:[）)]|理论|模型|框架|假设|变量))"),
)
