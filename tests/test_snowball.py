"""The stemmer against a vocabulary written by hand, the pipeline step by step."""

import pytest

from namewright.functions import snowball

# word:stem
VOCABULARY = """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist
consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid
consoling:consol consolingly:consol consols:consol consonant:conson consort:consort consorted:consort consorting:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci
conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir constable:constabl constables:constabl constance:constanc constancy:constanc constant:constant
knack:knack knackeries:knackeri knacks:knack knag:knag knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel
knees:knee knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive
knob:knob knobs:knob knock:knock knocked:knock knocker:knocker knockers:knocker knocking:knock knocks:knock knopp:knopp knot:knot knots:knot
caresses:caress ponies:poni ties:tie tied:tie cries:cri cats:cat gas:gas this:this gaps:gap kiwis:kiwi feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
luxuriated:luxuri troubled:troubl sized:size hopping:hop hoped:hope hoping:hope tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi cry:cri by:by say:say
relational:relat conditional:condit rational:ration digitizer:digit radically:radic differently:differ analogously:analog vietnamization:vietnam predication:predic operator:oper
feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formality:formal sensitivity:sensit sensibility:sensibl triplicate:triplic formative:format formalize:formal
electricity:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens
irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt activate:activ angularity:angular homologous:homolog effective:effect bowdlerize:bowdler
probate:probat rate:rate cease:ceas controlled:control rolled:roll roll:roll generate:generat generous:generous general:general generically:generic communities:communiti communism:communism arsenal:arsenal
skis:ski skies:sky dying:die news:news innings:inning proceeded:proceed exceeding:exceed youth:youth boyish:boyish yes:yes enjoy:enjoy flying:fli biology:biolog quickly:quick singly:singl
running:run runner:runner organization:organ university:univers beautiful:beauti nationally:nation restlessly:restless biologically:biolog studies:studi studying:studi used:use using:use
bed:bed red:red shred:shred bus:bus glass:glass abilities:abil theology:theolog truly:truli namely:name nicely:nice ion:ion million:million possession:possess
"""
PAIRS = [x.split(":") for x in VOCABULARY.split()]


def test_two_hundred_words(spark):
    assert len(PAIRS) >= 200
    got = snowball.with_stems(spark.createDataFrame([(w,) for w, _ in PAIRS], "w string"), "w").collect()
    assert {r["w"]: r["stem"] for r in got} == dict(PAIRS)
    odd = snowball.with_stems(spark.createDataFrame([(None,), ("",), ("a",), ("yy",), ("中文",)], "w string"), "w").collect()
    assert [r["stem"] for r in odd] == [None, "", "a", "yy", "中文"]


@pytest.mark.parametrize(
    "text,words",
    [
        ("The 3 Cats won't RUN, can't they?", ["cats", "run"]), ("I'm sure she'd've said it's 42nd", ["sure", "said", "nd"]), (None, None), ("", []), ("well-known e.g. A.I.", ["wellknown", "eg", "ai"]), ("we shouldn't; you'll", []),
        ("  two\nlines\tof   words ", ["two", "lines", "words"]),
    ],
)
def test_pipeline(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(snowball.words_of("t")).first()[0] == words
