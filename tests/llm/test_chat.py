from quire.llm import chat


def brute(rows):
    """{(conv, perspective): (text, mask spans)} of rows (conv, turn, role, text) without chunks."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        for who in {r[2] for r in turns if r[2] not in (None, "system")}:
            text, mask = "", []
            for _, _, role, said in turns:
                name = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in role or "unknown")
                text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={name}") + "\n"
                start = len(text)
                text += (said or "") + "<|im_end|>\n"
                if role == who:
                    mask.append((start, len(text) - 1))
            out[conv, who] = (text, mask)
    return out


ROWS = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi 😀"), (1, 2, "bob b", "yo"), (1, 3, "ann", None), (1, None, "cy", "last"), (2, 0, "ann", ""), (3, 0, "system", "alone"), (None, 0, "x", "y"), (4, 0, None, "?"), (4, 1, "ann", "!")] + [(9, k, "ab"[k % 2], f"turn {k}") for k in range(60)]


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "z", 0) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, mask string, position int")


def test_matches_brute_force(spark):
    got = {(r.conv_id, r.perspective): (r.text, [tuple(map(int, m.split(":"))) for m in r.mask.split(",") if m]) for r in chat.format_chats(frame(spark, ROWS)).collect()}
    assert got == brute(ROWS)
    assert chat.format_chats(frame(spark, ROWS).where("false")).count() == 0


def test_chunks_join_to_the_whole(spark):
    rows = chat.format_chats(frame(spark, ROWS), chunk_chars=200).collect()
    want = brute(ROWS)
    for key, (text, mask) in want.items():
        mine = sorted((r for r in rows if (r.conv_id, r.perspective) == key), key=lambda r: r.chunk)
        assert "".join(r.text for r in mine) == text
        at, spans = 0, []
        for r in mine:
            spans += [(at + int(a), at + int(b)) for a, b in (m.split(":") for m in r.mask.split(",") if m)]
            at += len(r.text)
        assert spans == mask
    assert max(r.chunk for r in rows) > 3


def test_repeated_turns_stay(spark):
    rows = [(1, 0, "a", "x")] * 5 + [(1, 0, "b", "x")]
    got = {r.perspective: (r.n_turns, r.mask.count(":")) for r in chat.format_chats(frame(spark, rows)).collect()}
    assert got == {"a": (6, 5), "b": (6, 1)}


def test_ties_go_by_text(spark):
    rows = [(1, 0, "a", "zeta"), (1, 0, "a", "alpha"), (1, 0, "a", None), (1, 0, "b", "x")]
    for shuffled in (rows, rows[::-1]):
        got = {(r.conv_id, r.perspective): r.text for r in chat.format_chats(frame(spark, shuffled)).collect()}
        assert got == {k: t for k, (t, _) in brute(rows).items()}


def test_conversations_over_many_ranges(spark):
    """A conversation with a third of all turns, in small ranges and small chunks, and equal turns by the hundred."""
    rows = [(c, t, "abc"[(c + t) % 3], f"turn {t} " + "x" * (t % 40)) for c in range(30) for t in range(12)] + [(77, t, "pqr"[t % 3], f"long {t} é😀") for t in range(300)] + [(99, 0, "a", "same")] * 150 + [(None, 5, "a", "n")] * 40
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = chat.format_chats(frame(spark, rows).repartition(5), chunk_chars=700).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute(rows)
    assert len({(r.conv_id, r.perspective, r.chunk) for r in got}) == len(got)
    for key, (text, mask) in want.items():
        mine = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.chunk)
        assert "".join(r.text for r in mine) == text
        at, spans = 0, []
        for r in mine:
            spans += [(at + int(a), at + int(b)) for a, b in (m.split(":") for m in r.mask.split(",") if m)]
            at += len(r.text)
        assert spans == mask
    assert {(r.conv_id, r.perspective) for r in got} == set(want)
