import random
import re

import numpy as np
import pytest

from sievelake.llm import pieces


def stretch(d):
    ends = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r|\0+", d)), len(d)]
    return max(b - a for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("alphabet", [b"ab\n", b"abcdefgh\n\r\0", b"abcdefghijkl\r\n", "äöü漢\n".encode(), b"abcdefghijklmnopqrstuvwx\n"])
def test_cut(alphabet):
    rnd = random.Random(3)
    for _ in range(600):
        d = bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 300)))
        window, overlap = rnd.randrange(1, 60), rnd.randrange(0, 70)
        s, e, natural, longest = pieces.cut(d, window, overlap)
        if not d:
            assert len(s) == 0
            continue
        kept = overlap if overlap < window else 0
        assert (longest > window) == (len(d) > window and stretch(d) > window) and (longest > 0) == (not natural.all())
        assert s[0] == 0 and e[-1] == len(d) and (e - s <= window).all() and (np.diff(e) > 0).all()
        assert (s[1:] == np.maximum(e[:-1] - kept, 0)).all()
        assert d[s[0] : e[0]] + b"".join(d[a:b] for a, b in zip(e, e[1:])) == d
        ends = {m.end() for m in re.finditer(rb"\r\n|\n|\r|\0+", d)} | {len(d)}
        assert all(int(x) in ends for x, n in zip(e, natural) if n)
        if stretch(d) <= window - kept:
            assert natural.all()


def test_characters_stay_whole():
    d = ("漢字" * 400).encode()
    s, e, natural, _ = pieces.cut(d, 100, 0)
    assert not natural[:-1].any() and all(d[a:b].decode() for a, b in zip(s, e))


def test_pieces_are_balanced():
    d = b"\n".join(b"x" * 9 for _ in range(100)) + b"\n"
    s, e, _, _ = pieces.cut(d, 300, 0)
    assert len(s) == 4 and (e - s).min() >= 230


def test_only_the_bare_stretch_is_cut_elsewhere():
    lines = b"".join(b"line %05d\n" % k for k in range(300))
    d = lines + b"x" * 2500 + b"\n" + lines
    s, e, natural, longest = pieces.cut(d, 1000, 100)
    assert longest == 2501 and (~natural).sum() == 2 and all(3300 < x < 5801 for x in e[~natural])
    assert len(s) <= -(-(len(d) - 100) // 900) + 1 and (e - s)[:-1].min() > 600


def test_sparse_boundaries_need_more_pieces():
    d = b"".join(b"y" * k + b"\n" for k in [89, 30, 89, 30, 89, 30, 89, 30, 89, 89, 20, 89, 70, 89])
    s, e, natural, longest = pieces.cut(d, 100, 10)
    assert natural.all() and longest == 0 and (e - s).max() <= 100


WRITERS = [(1, 10, 3), (2, None, None), (3, 8, 8), (None, 5, 1)]
BLOCKS = [(1, 1, 1, 100, b"aaaa\nbbbb\ncccc\n"), (2, 1, 2, None, b"x" * 40000), (3, 2, 3, 0, b"abc\0\0\0\0\0\0def"), (4, 2, 1, 0, None), (5, None, 1, 0, b""), (6, 3, 77, 0, b"short"), (7, 3, 1, 0, b"y" * 11), (1, 1, 1, 100, b"aaaa\nbbbb\ncccc\n")]


def tables(spark, blocks=BLOCKS):
    b = spark.createDataFrame([(*x, 1) for x in blocks], "block_id long, run_id long, writer_id int, base_address long, payload binary, window_size int")
    return b, spark.createDataFrame(WRITERS, "writer_id int, window_size long, overlap_size long")


def test_operator(spark):
    got = {}
    for r in pieces.pieces(*tables(spark)).collect():
        got.setdefault(r.block_id, []).append((r.piece_no, r.start_offset, r.end_offset, r.address, bytes(r.content)))
    assert sorted(got[1]) == sorted(2 * [(1, 0, 10, 100, b"aaaa\nbbbb\n"), (2, 7, 15, 107, b"bb\ncccc\n")])
    assert [x[1:3] for x in got[2]] == [(0, 20256), (19744, 40000)] and got[6] == [(1, 0, 5, 0, b"short")]
    assert 4 not in got and 5 not in got
    report = {r.block_id: (r.n_pieces, r.n_forced, r.uncuttable) for r in pieces.block_report(*tables(spark)).collect()}
    assert report == {1: (2, 0, False), 2: (2, 1, True), 3: (2, 1, True), 4: (0, 0, False), 5: (0, 0, False), 6: (1, 0, False), 7: (2, 1, True)}


def test_regions(spark):
    stats = spark.createDataFrame([(1, None, 9), (1, None, 9), (2, 0, 9), (9, 0, 9)], "run_id long, n_regions long, n_files long")
    assert sorted((r.run_id, r.n_regions) for r in pieces.regions(*tables(spark), stats).collect()) == [(1, 6), (2, 2), (9, 0)]


def test_empty(spark):
    assert pieces.pieces(*tables(spark, [])).count() == 0
