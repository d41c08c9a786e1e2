"""Double Metaphone against published keys, and answers scored by sound against a plain pass."""

import pytest
from pyspark.sql import functions as F

from driverscope.functions.sound import double_metaphone, sound, twice, with_sounds
from driverscope.operators import audio

# Keys given with the published algorithm, in its comments and in common test lists.
PUBLISHED = {
    "ball": "PL PL", "bow": "P PF", "boat": "PT PT", "james": "JMS AMS", "yes": "AS AS", "smith": "SM0 XMT", "schmidt": "XMT SMT", "thompson": "TMPSN TMPSN", "thomas": "TMS TMS",
    "michael": "MKL MXL", "caesar": "SSR SSR", "chianti": "KNT KNT", "architect": "ARKTKT ARKTKT", "orchestra": "ARKSTR ARKSTR", "accident": "AKSTNT AKSTNT", "bacchus": "PKS PKS",
    "focaccia": "FKX FKX", "mchugh": "MK MK", "edge": "AJ AJ", "edgar": "ATKR ATKR", "ghislane": "JLN JLN", "ghost": "KST KST", "laugh": "LF LF", "cough": "KF KF", "tough": "TF TF",
    "hugh": "H H", "bough": "P P", "broughton": "PRTN PRTN", "tagliaro": "TKLR TLR", "danger": "TNJR TNKR", "cabrillo": "KPRL KPR", "gallegos": "KLKS KKS", "dumb": "TM TM", "thumb": "0M TM",
    "plumber": "PLMR PLMR", "campbell": "KMPL KMPL", "raspberry": "RSPR RSPR", "rogier": "RJ RJR", "hochmeier": "HKMR HKMR", "island": "ALNT ALNT", "isle": "AL AL", "sugar": "XKR SKR",
    "school": "SKL SKL", "schooner": "SKNR SKNR", "schermerhorn": "XRMRRN SKRMRRN", "schenker": "XNKR SKNKR", "resnais": "RSN RSNS", "artois": "ART ARTS", "nation": "NXN NXN", "arnow": "ARN ARNF",
    "filipowicz": "FLPTS FLPFX", "breaux": "PR PR", "zhao": "J J", "wright": "RT RT", "knee": "N N", "psalm": "SLM SLM", "xavier": "SF SFR", "wasserman": "ASRMN FSRMN", "uomo": "AM AM", "jose": "HS HS",
    "": " ", "123": " ", "é": "A A",
}


@pytest.mark.parametrize("word", PUBLISHED)
def test_published_keys(word):
    assert " ".join(double_metaphone(word)) == PUBLISHED[word]


def plain_similarity(a, b):
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_answers_by_sound_equal_a_plain_pass(spark):
    answers = [("james bow yes", "james ball yes"), ("now way", "no"), ("the gray-boat  sank", "a grey boat"), ("", "x"), ("1 2", "boat"), (None, "a"), ("a", None)] * 3
    rows = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(answers)], "i int, answer string, gt string").repartition(4)
    scored = {r.i: r for r in audio.score_answers(rows, "statement_task").collect()}
    assert len(scored) == len(answers)
    for i, (a, g) in enumerate(answers):
        if a is None or g is None:
            assert scored[i].score is None
            continue
        heard, wanted = ([twice(w) for w in scored[i][c].replace("-", " ").split(" ")] for c in ("normalised_answer", "normalised_gt"))
        want = sum(max(plain_similarity(w, h) for h in heard) for w in wanted) / len(wanted)
        assert scored[i].score == pytest.approx(want)
    assert scored[0].score == pytest.approx((1 + 0.5 + 1) / 3)


def test_sounds_keep_missing_words_and_lists(spark):
    rows = spark.createDataFrame([(1, ["boat", None, "bow"]), (2, None), (3, [])], "k int, w array<string>")
    assert {r.k: r.s for r in with_sounds(rows, {"s": F.col("w")}).collect()} == {1: ["PT", None, "P"], 2: None, 3: []}
    assert sound("boat") == "PT"
