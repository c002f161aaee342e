from __future__ import annotations

import random
import string

from tests.llm.util import docs, prose
from tillpoint.llm import line_dedup


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    lines = [(d, i, s) for d, t, *_ in rows if d is not None for i, raw in enumerate((t or "").split("\n")) if t is not None
             and (s := raw.strip(line_dedup.SPACE))]
    near = lambda s, u: min(len(s), len(u)) >= line_dedup.MIN_CHARS and one_edit(s, u)
    gone = {(d, i) for d, i, s in lines if any((e, j) < (d, i) and (s == u or near(s, u)) for e, j, u in lines)}
    out = []
    for d, t, *_ in rows:
        raw = None if t is None else t.split("\n")
        kept = None if raw is None else "\n".join(x for i, x in enumerate(raw) if (d, i) not in gone)
        out.append((d, kept, len(raw or ()), sum((d, i) in gone for i in range(len(raw or ())))))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows, **kw)).collect()), key=str)


def near(s, seed):
    r = random.Random(seed)
    for _ in range(r.choice([0, 1, 1, 2])):
        i, k = r.randrange(len(s) + 1), r.randrange(3)
        s = s[:i] + r.choice(string.ascii_letters + "éß") + s[i:] if k == 0 else s[:i] + s[i + 1:] if k == 1 else s[:i] + r.choice("xyzé") + s[i + 1:]
    return s


def test_equals_brute_force(spark):
    r = random.Random(1)
    pool = [prose(i, r.choice([2, 3, 8, 30])) for i in range(30)] + ["Page 1 of 9", "aaaaaaaaaaaa", "aaaaaaaaaaa", "éééééééééé", "short", "x" * 5000]
    rows = []
    for d in range(60):
        lines = [r.choice(["", " ", "\t", ""]) + near(r.choice(pool), 100 * d + k) + r.choice(["", " ", "\r"]) for k in range(r.randrange(1, 9))]
        rows.append((r.randrange(10 ** 6), "\n".join(lines)))
    rows += [(10 ** 6 + 1, None), (10 ** 6 + 2, ""), (10 ** 6 + 3, "\n\n"), (None, pool[0]), (10 ** 6 + 4, pool[0] + "\n" + pool[0])]
    assert run(spark, rows, extra=False) == brute(rows)


def test_replaced_inserted_and_deleted_points_at_the_edges(spark):
    rows = [(1, "abcdefghij"), (2, "Xbcdefghij"), (3, "abcdefghiX"), (4, "abcdefghijX"), (5, "Xabcdefghij"), (6, "bcdefghij"), (7, "abcdXefghij"), (8, "XbcdefghiX"), (9, "badcfehgji")]
    assert run(spark, rows) == brute(rows)


def test_hot_line_repeated_rows_and_empty_table(spark):
    rows = [(i, "a line that everyone has\n" + prose(i, 6, 10 ** 6)) for i in range(200)]
    assert run(spark, rows) == brute(rows)
    twice = [(1, "one long line"), (1, "one long line"), (2, "one long line")]
    assert run(spark, twice) == [(1, "one long line", 1, 0), (1, "one long line", 1, 0), (2, "", 1, 1)]
    assert run(spark, []) == []


def test_clashing_columns_stay(spark):
    df = docs(spark, [(1, "some long line"), (2, "some long line")], extra=True)
    out = line_dedup.dedup_lines(df, n_lines="had", n_removed="lost")
    assert out.columns == [*df.columns, "had", "lost"] and {r.line for r in out.collect()} == {"clash"}


def test_equal_lines_of_any_length_go(spark):
    rows = [(1, "}\nLes.\n\n  \n}"), (2, "Les.\nLe.\n\n\t}"), (3, "Les\n語\nnew"), (4, "語 \n語言")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows)[1] == (2, "Le.\n", 4, 2) and run(spark, rows)[3] == (4, "語言", 2, 1)


def test_edits_in_every_segment_and_at_their_edges(spark):
    line = "".join(random.Random(3).choices(string.ascii_lowercase, k=41))
    rows = []
    for k in range(41):
        rows += [(10 * k, f"{k:02d}" + line), (10 * k + 1, f"{k:02d}" + line[:k] + "#" + line[k + 1:]), (10 * k + 2, f"{k:02d}" + line[:k] + "#" + line[k:]),
                 (10 * k + 3, f"{k:02d}" + line[:k] + line[k + 1:]), (10 * k + 4, f"{k:02d}" + line[:k] + "##" + line[k:])]
    assert run(spark, rows) == brute(rows)
