"""Prose is prose in scripts whose vowels aren't listed; noise stays noise."""

import pytest

from tidewake.llm.quality import text_statistics

PROSE = {
    "arabic": "ذهب الولد إلى المدرسة في الصباح الباكر وكان الجو جميلا والشمس مشرقة.",
    "hebrew": "הילד הלך לבית הספר מוקדם בבוקר ומזג האוויר היה נעים מאוד באותו יום.",
    "devanagari": "लड़का सुबह जल्दी स्कूल गया और मौसम बहुत अच्छा था, इसलिए सब बच्चे खुश थे।",
    "hangul": "소년은 아침 일찍 학교에 갔고 날씨가 아주 좋아서 모두가 기뻐하며 걸었습니다.",
    "georgian": "ბიჭი დილით ადრე წავიდა სკოლაში და ამინდი ძალიან კარგი იყო იმ დღეს.",
    "armenian": "Տղան վաղ առավոտյան գնաց դպրոց, և եղանակը շատ լավ էր այդ օրը:",
    "thai": "เด็กชายไปโรงเรียนแต่เช้าและอากาศดีมากทุกคนจึงมีความสุขในวันนั้นและเดินกลับบ้านด้วยกัน",
    "chinese": "男孩一大早就去了学校，那天天气非常好，所以大家都很高兴地一起走路回家，路上还唱着歌，谁也不觉得累。",
}


@pytest.mark.parametrize("script", PROSE)
def test_prose_of_other_scripts(script):
    assert text_statistics(PROSE[script], frozenset())["not_prose_share"] < 0.5


@pytest.mark.parametrize("text", ["xkcd qwrt zzgh plkj mnbv hgfd", "χκδφ γθρτ ζξψλ πκτγ", "𝐱𝐤𝐜𝐝 𝐪𝐰𝐫𝐭 𝐳𝐳𝐠𝐡 𝐩𝐥𝐤𝐣"])
def test_noise_of_listed_scripts(text):
    assert text_statistics(text, frozenset())["junk_share"] == 1


NEWS = {
    "arabic": "أعلنت وزارة الصحة أمس أن عدد المصابين انخفض خلال الأسبوع الماضي.\nوقال المتحدث باسم الوزارة إن المستشفيات استعادت نشاطها المعتاد، ودعا السكان إلى الحذر.\nوأضاف أن الحملة ستستمر حتى نهاية الشهر.\nوفي المدن الكبرى عادت المدارس إلى العمل.",
    "hebrew": "משרד הבריאות הודיע אתמול כי מספר החולים ירד במהלך השבוע האחרון.\nדובר המשרד אמר שבתי החולים חזרו לפעילות רגילה וקרא לתושבים להיזהר.\nהוא הוסיף כי המבצע יימשך עד סוף החודש.\nבערים הגדולות חזרו בתי הספר לפעול.",
    "chinese": "卫生部昨天宣布，过去一周的感染人数有所下降。\n发言人说，医院已经恢复正常运作，并呼吁居民保持谨慎。\n他还说，活动将持续到月底。\n大城市的学校已经复课。\n专家预计情况将很快进一步改善。",
    "japanese": "保健省は昨日、過去一週間の感染者数が減少したと発表した。\n報道官は、病院は通常の業務に戻ったと述べ、住民に注意を呼びかけた。\nまた、運動は月末まで続くと付け加えた。\n大都市では学校が再開した。",
    "korean": "보건부는 어제 지난주 감염자 수가 감소했다고 발표했다.\n대변인은 병원이 정상 운영을 재개했다고 말하며 주민들에게 주의를 당부했다.\n그는 캠페인이 월말까지 계속될 것이라고 덧붙였다.\n대도시에서는 학교가 다시 문을 열었다.",
    "georgian": "ჯანდაცვის სამინისტრომ გუშინ განაცხადა, რომ ინფიცირებულთა რიცხვი შემცირდა.\nპრესსპიკერმა თქვა, რომ საავადმყოფოები ჩვეულ რეჟიმს დაუბრუნდნენ.\nმან დასძინა, რომ კამპანია თვის ბოლომდე გაგრძელდება.\nდიდ ქალაქებში სკოლები გაიხსნა.",
    "thai": "กระทรวงสาธารณสุขประกาศเมื่อวานนี้ว่าจำนวนผู้ติดเชื้อลดลงในช่วงสัปดาห์ที่ผ่านมา\nโฆษกกระทรวงกล่าวว่าโรงพยาบาลกลับมาดำเนินการตามปกติแล้ว และขอให้ประชาชนระมัดระวัง",
    "devanagari": "स्वास्थ्य मंत्रालय ने कल घोषणा की कि पिछले सप्ताह संक्रमितों की संख्या घट गई है।\nप्रवक्ता ने कहा कि अस्पतालों में सामान्य काम फिर शुरू हो गया है।\nउन्होंने कहा कि अभियान महीने के अंत तक चलेगा।\nबड़े शहरों में स्कूल फिर खुल गए हैं।",
    "armenian": "Առողջապահության նախարարությունը երեկ հայտարարեց, որ վարակվածների թիվը նվազել է։\nԽոսնակն ասաց, որ հիվանդանոցները վերադարձել են բնականոն աշխատանքի։\nՆա ավելացրեց, որ արշավը կշարունակվի մինչև ամսի վերջ։\nՄեծ քաղաքներում դպրոցները վերաբացվել են։",
    "cyrillic": "Министерство здравоохранения вчера сообщило, что число заболевших снизилось.\nПредставитель сказал, что больницы вернулись к обычной работе.\nОн добавил, что кампания продлится до конца месяца.\nВ крупных городах школы снова открылись.",
}
COMMON = frozenset("a an the of and to in i that was is for it with as on by at from before had though my all what".split())
VERSE = (
    "The woods are quiet in the morning light,\nA river wanders slowly to the sea\nAnd carries every echo of the night,\nThe softened laughter of the willow tree\nThat bends to hear what water has to say",
    "I went to find the pasture gate\nBefore the sun had touched the hill\nAnd though I knew the hour was late\nThe herd was standing very still\n\nThe bells were hung about the door\nAnd all the dogs had gone to sleep\nI heard my father cross the floor\nTo count again his missing sheep",
    '"Did you see the boat?" she asked.\n"No," he said.\n"It came in before the rain, and nobody was on it."\n"Are you sure?"\n"I was there."\n"Then we must tell the others," he answered.',
)
NAMES = ("Anna Lee", "Bob Ray", "Cara Moss", "Dan Holt", "Eva Kern", "Finn Dale", "Gus Ohm", "Hana Ito", "Ida Voss", "Jon Park")


@pytest.mark.parametrize("script", NEWS)
def test_news_of_several_lines(script):
    assert text_statistics(NEWS[script], COMMON)["not_prose_share"] < 0.5


@pytest.mark.parametrize("text", VERSE)
def test_verse_and_dialogue_are_prose(text):
    assert text_statistics(text, COMMON)["not_prose_share"] < 0.5


def test_records_told_by_the_period_of_their_lines_alone():
    job = "Responsible for the supervision of regional distribution contracts and the yearly review of all transport partners in district {}, reporting to the board."
    records = [x for i, n in enumerate(NAMES) for x in (f"{n}.", job.format(i), f"Since 19{70 + i}.")]
    assert text_statistics("\n".join(records), COMMON)["list_share"] > 0.5
    mixed = [records[i] for i in (0, 1, 4, 7, 2, 3, 5, 10, 6, 8, 9, 11, 13, 12, 16, 14)]
    assert text_statistics("\n".join(mixed), COMMON)["list_share"] < 0.5


def test_records_told_by_the_period_of_their_indentation():
    text = "\n".join(("        " if i % 3 else "") + f"The {n} was told of it and went to the {w} of the town." for i, (n, w) in enumerate(zip(NAMES * 3, ("mill", "harbour", "gate", "old library") * 8)))
    assert text_statistics(text, COMMON)["list_share"] > 0.5
    assert text_statistics(text.replace("        ", ""), COMMON)["list_share"] < 0.5
