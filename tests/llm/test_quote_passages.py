import random

from brindle.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _by_turn(spark, texts):
    rows = [(1, turn, "user", text) for turn, text in texts.items()]
    return {r.turn: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_latest_turn_and_fullest_cover(spark):
    got = _by_turn(spark, {
        1: "the longer line of these two stands here\nother",
        3: "Thanks\nthe longer line of these two stands here\nshort one",
        4: "> the longer line of these two stands here\n> short one\nyes",
        1500: "Thanks\nnew matter",
        1501: "> Thanks\nwelcome",
        1502: "> short one\n> made up by nobody\n> the longer line of these two stands here\nedited",
        1503: "> Thanks\n\nand\n\n>> never\n> said this",
    })
    assert got[4].reply_to == 3 and got[4].n_linked == 2
    assert got[1501].reply_to == 1500 and got[1501].thread == 1500
    assert (got[1502].reply_to, got[1502].n_quoted, got[1502].n_linked) == (3, 3, 2)
    assert (got[1503].reply_to, got[1503].n_quoted, got[1503].n_linked, got[1503].quote_depth) == (1500, 3, 1, 2)


def test_rewrapped_passage(spark):
    got = _by_turn(spark, {0: "One sentence that is rather\nlong goes over three\nlines of text.", 1: "> One sentence that is\n> rather long goes\n>\n> over three lines of text.\nso?", 2: "> rather long goes over\nhm", 3: "> long\n> goes OVER three lin\nno"})
    assert (got[1].reply_to, got[1].n_linked) == (0, 3)
    assert (got[2].reply_to, got[2].n_linked) == (0, 1)
    assert (got[3].reply_to, got[3].n_linked) == (0, 1)


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for turn in range(0, 60_000, 400):
        own = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
        quote = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 3))]
        texts[turn] = "\n".join([f"> {x}" for x in quote] + own)
    held = lambda words, turn: f" {words} " in " " + " ".join(x for x in texts[turn].split("\n") if x[0] != ">") + " "
    got = _by_turn(spark, texts)
    for turn, text in texts.items():
        lines = [x[2:] for x in text.split("\n") if x[0] == ">"]
        cover = {t: len(" ".join(lines)) if held(" ".join(lines), t) else sum(len(x) for x in lines if held(x, t)) for t in texts if t < turn}
        whole = [t for t in cover if lines and held(" ".join(lines), t)]
        best = max(whole, default=None) if whole else max(((n, t) for t, n in cover.items() if n), default=(0, None))[1]
        linked = len(lines) if whole else sum(any(held(x, t) for t in cover) for x in lines)
        assert (got[turn].reply_to, got[turn].n_quoted, got[turn].n_linked) == (best, len(lines), linked)
