"""The published vocabulary of the English stemmer, its special words and its rules."""

import pytest

from timeweave.functions.stemmer import SPECIAL, Stems, stem

SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
"""
RULES = """
caresses caress gas gas gaps gap kiwis kiwi ties tie cries cri tied tie pus pus miss miss agreed agre feed feed luxuriated luxuri hopping hop hoped hope
hoping hope bled bled sing sing shred shred shed shed embed emb beds bed cry cri by by say say enjoying enjoy playful play sensational sensat valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog organization organ organizations organ
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
geology geolog theology theolog triplicate triplic formative format formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt communism communism communication communic communities communiti activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generate generat generates generat generated generat generating generat
general general generally general generic generic generically generic generous generous generously generous arsenal arsenal arsenic arsenic
colliders collid colliding collid collider collid collides collid rigidbody rigidbodi running run runs run runner runner easily easili quickly quick
yes yes youth youth boyish boyish flying fli dying die skies sky news news inning inning innings inning proceeded proceed succeeds succeed exceeding exceed
singing sing kneeled kneel ly ly a a ox ox
"""


def pairs(text):
    words = text.split()
    return list(zip(words[::2], words[1::2], strict=True))


@pytest.mark.parametrize("sample", [SAMPLE, RULES])
def test_words_have_their_published_stems(sample):
    assert {w: stem(w) for w, _ in pairs(sample)} == dict(pairs(sample))
    assert len(pairs(SAMPLE)) + len(pairs(RULES)) > 190


def test_special_words():
    assert {w: stem(w) for w in SPECIAL} == SPECIAL
    assert stem("'tis's") == "tis" and stem("dogs'") == "dog"


def test_memo_begins_anew():
    own = Stems(most=3)
    assert [own[w] for w in ("cats", "dogs", "birds", "trees", "cats")] == ["cat", "dog", "bird", "tree", "cat"] and len(own) <= 3
