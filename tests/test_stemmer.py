import pytest

from phrasewell.functions.stemmer import stem

#: Published vectors of the English stemmer, and the special cases of this one.
VECTORS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist",
    "consistently": "consist", "consolation": "consol", "consolingly": "consol", "knack": "knack", "knightly": "knight",
    "knots": "knot", "kneeled": "kneel", "generate": "generat", "generously": "generous", "hoping": "hope", "hopping": "hop",
    "caresses": "caress", "ponies": "poni", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre",
    "luxuriated": "luxuri", "cry": "cri", "by": "by", "say": "say", "happy": "happi", "skis": "ski", "dying": "die",
    "news": "news", "inning": "inning", "succeed": "succeed", "proceeding": "proceed", "relational": "relat", "analogi": "analog",
    "adoption": "adopt", "electricity": "electr", "controlling": "control", "rate": "rate", "yes": "yes", "it's": "it", "'tis": "tis",
    "café": "café", "at": "at", "": "",
}


@pytest.mark.parametrize(("word", "want"), VECTORS.items())
def test_vectors(word, want):
    assert stem(word) == want


def test_any_word_has_a_stem():
    for n in range(1, 5):
        for seed in ("y", "ayys", "'s'", "eed", "ing", "sses", "ied", "ll", "e", "bb"):
            assert isinstance(stem(seed * n), str)
