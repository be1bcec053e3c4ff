"""Snowball stems: the published sample vocabulary and what the rules say by hand."""

import pytest
from lectern.operators.models import porter, snowball, stemmed

SAMPLE = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol,
consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee,
kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit,
knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot"""
BY_RULE = """generously generous, generate generat, communism communism, community communiti, arsenal arsenal, skies sky, dying die, news news, inning inning, innings inning, proceed proceed, exceeds exceed, tied tie, cries cri, ties tie, gas gas, this this, gaps gap, kiwis kiwi,
hopping hop, hoping hope, luxuriated luxuri, agreed agre, feed feed, disabled disabl, sized size, by by, say say, cry cri, enjoy enjoy, youth youth, boyish boyish, flying fli, rational ration, relational relat, apology apolog, geology geolog, quickly quick, replacement replac, adoption adopt,
fall fall, controll control, rate rate, beds bed, boy's boy, boys' boy, 'tis tis, national nation, formative format, nationality nation, hopefully hope, fearlessly fearless, ability abil, operator oper, bled bled, sing sing, ly ly, c++ c++, été été"""


def pairs(text):
    return [tuple(p.split()) for p in text.replace("\n", " ").split(", ")]


@pytest.mark.parametrize(("word", "stem"), pairs(SAMPLE) + pairs(BY_RULE))
def test_snowball(word, stem):
    assert snowball(word) == stem


def test_both_agree_on_plain_endings(spark):
    words = ["caresses", "ponies", "cats", "plastered", "motoring", "happy", "relational", "hopefulness", "electrical", "adjustment", "revival", "effective", "roll"]
    assert [porter(w) for w in words if porter(w) != snowball(w)] == []
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    assert [r.stem for r in stemmed(rows, "w", "snowball").collect()] == [*map(snowball, words), None]
