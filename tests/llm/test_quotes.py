from brindle.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, norm string"


def test_links_threads_and_text(spark):
    rows = [
        (1, 0, "user", "How do  I sort?\nIn place."),
        (1, 1, "assistant", "> how do i SORT?\nCall sort()."),
        (1, 2, "user", "On Monday assistant wrote:\n> > How do I sort?\n> Call sort().\n\n\n\nThanks"),
        (1, 3, "user", "Another matter\r\n>"),
        (1, 4, "assistant", ">never said\nfine"),
        (1, 5, "user", ">> > fine\nok"),
        (2, 9, "user", "> How do I sort?\nother conversation"),
        (None, 1, "user", "> How do I sort?"),
        (3, None, "user", "x"),
        (3, 1, None, None),
        (3, 1, "user", "a > b"),
        (3, 1, "user", "a > b"),
    ]
    frame = spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA)
    got = quotes.link(frame).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].reply_to, by[1, 1].thread, by[1, 1].text, by[1, 1].n_linked) == (0, 0, "Call sort().", 1)
    assert (by[1, 2].reply_to, by[1, 2].thread, by[1, 2].text, by[1, 2].quote_depth) == (1, 0, "Thanks", 2)
    assert (by[1, 3].reply_to, by[1, 3].thread, by[1, 3].n_quoted) == (None, 3, 0)
    assert (by[1, 4].reply_to, by[1, 4].n_quoted, by[1, 4].n_linked, by[1, 4].text) == (None, 1, 0, ">never said\nfine")  # stands nowhere else
    assert (by[1, 5].reply_to, by[1, 5].thread, by[1, 5].quote_depth) == (4, 4, 3)
    assert by[2, 9].reply_to is None and by[None, 1].thread == 1 and by[3, None].thread is None
    assert sum(r.text == "a > b" for r in got) == 2
    assert quotes.link(frame.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(5, i, "user", f"line {i}\n> line {i - 1}" if i else "line 0") for i in range(40)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all(r.position == r.turn for r in got)
    assert {r.thread for r in got} == {0} and all(r.reply_to == (r.turn - 1 if r.turn else None) for r in got)


def walk(parent, turns):
    """(thread, position) of every turn, by recursion over replies in ascending order."""
    out = {}
    children = {}
    for t in turns:
        children.setdefault(parent.get(t), []).append(t)

    def visit(t, root):
        out[t] = (root, sum(1 for v in out.values() if v[0] == root))
        for c in sorted(children.get(t, [])):
            visit(c, root)

    for t in sorted(children.get(None, [])):
        visit(t, t)
    return out


def test_reply_order_against_brute_force(spark):
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(4):
        turns = sorted(rng.sample(range(9000), 60))
        parent = {}
        for i, t in enumerate(turns):
            if i and rng.random() < 0.8:
                parent[t] = rng.choice(turns[max(0, i - 12) : i] if conv % 2 else turns[:i])
            rows.append((conv, t, "user", (f"> message {conv} number {parent[t]} here\n" if t in parent else "") + f"message {conv} number {t} here"))
        want |= {(conv, t): (parent.get(t), *v) for t, v in walk(parent, turns).items()}
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.position) for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == want


def test_text_keeps_what_stands_nowhere_else(spark):
    long_intro = "On " + "day " * 200 + "somebody wrote " + "and wrote " * 100 + ":"
    rows = [
        (1, 0, "a", "first line here\nsecond line here"),
        (1, 1, "b", f"{long_intro}\n> first line here\n>\n> made up\n> second line here\nanswer"),
        (1, 2, "c", ">>> code = 1\n>>> run(code)\nfine"),
        (1, 3, "d", "On it he wrote:\nnothing quoted"),
        (1, 4, "e", "> answer\n" * 3000 + "x"),
    ]
    got = {r.turn: r.text for r in quotes.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {0: rows[0][3], 1: "> made up\nanswer", 2: rows[2][3], 3: rows[3][3], 4: "x"}
