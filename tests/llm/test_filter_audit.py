from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from tests.llm.util import docs, prose
from tillpoint.llm import filter_audit as fa

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, mask string, n string"


def fails(rows):
    """(part, letters failed, doc_id) of ``(doc_id, text, lang)`` rows, straight from the rules."""
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    out = []
    for i, text, lang in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ("A" if len(ws) < 200 else "") + ("B" if 100 * len(set(ws)) < 50 * len(ws) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "")
        f += ("D" if re.search(r"[#$%&*|]", t) else "") + ("E" if i is not None and low[t] < i else "")
        out.append((lang or "", f, i))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    failed, out = fails(rows), []
    for part in sorted({p for p, _, _ in failed}):
        mine, shapley, found = [(f, i) for p, f, i in failed if p == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order):
                gone, ids = [d for d in left if x in d[0]], [d[1] for d in left if x in d[0]]
                again = sum(x in f for f, _ in mine) - len(gone)
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                found.append([part, "".join(order), step + 1, len(left), len(gone), again, sum(f == x for f, _ in mine), sum(i in good for i in ids), sum(i in toxic for i in ids)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def made(spark, rows, extra=False):
    df = docs(spark, [(i, t) for i, t, _ in rows], extra=extra)
    lang = spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "k int, lang string")
    rows_df = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(rows)], "k int, doc_id long, text string").join(lang, "k").drop("k")
    return rows_df if not extra else rows_df.withColumns({c: F.lit("clash") for c in df.columns if c not in ("doc_id", "text", "lang")} | {c: F.lit(1) for c in ("mask", "part", "digest", "is_first")})


def test_equals_brute_force(spark):
    long, shout, marks = prose(1, 300), prose(2, 260) + " ABC" * 30, prose(3, 220) + " # | *"
    rows = [(1, long, "en"), (2, long, "de"), (2, long, "de"), (3, shout, "en"), (4, marks, "en"), (5, marks, "de"), (6, "w " * 400, "fr"), (7, None, None), (8, "", "en"),
            (9, "a b  C\tD", ""), (None, long, "en"), (None, None, None), (10, "é" * 5000 + " ABC", "fr"), (11, "x y " * 150 + "A&" * 99, "fr"), (12, " \n\t", "fr"), (1, shout, "en"),
            *[(100 + k, "short # copy", "en") for k in range(60)], *[(20 + k, prose(k, 150 + 10 * k, 200), "de") for k in range(12)]]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (5, 0, 1), (100, 1, 0), (130, None, 1), (None, 1, 1), (999, 1, 1)]
    df = fa.audit_documents(made(spark, rows, extra=True), spark.createDataFrame([(*r, "clash", "clash") for r in labels], LABELS))
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect())) == brute(rows, labels)


def test_empty_table(spark):
    assert fa.audit_documents(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    rows = [(1, "a", "en")]
    assert sorted(map(tuple, fa.audit_documents(made(spark, rows), spark.createDataFrame([], LABELS)).collect())) == brute(rows, [])


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_intervals_hold_each_order_once(k):
    orders = list(permutations(range(k)))
    at = {}
    for mask, step, redundant, a, b in fa.intervals(k):
        assert 0 <= a < b <= factorial(k)
        for rank in range(a, b):
            assert at.setdefault((mask, rank, step), redundant) == redundant
    for mask in range(1 << k):
        for rank, order in enumerate(orders):
            hits = [s + 1 for s, f in enumerate(order) if mask >> f & 1]
            assert [at.get((mask, rank, s)) for s in range(1, k + 1)] == [0 if hits[:1] == [s] else 1 if s in hits else None for s in range(1, k + 1)]


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 2), ("p", 3, 1, 0, 0), ("q", 7, 9, 9, 0)], "part string, mask int, n long, good long, toxic long")
    out = {(r.part, r.filter_order, r.step): r for r in fa.audit(counts, "XYZ").collect()}
    assert len(out) == 2 * 6 * 3
    assert out["p", "YXZ", 1].removed == 5 and out["p", "YXZ", 2].removed == 2 and out["p", "YXZ", 2].redundant == 5 and out["p", "YXZ", 3].kept == 5
    assert out["p", "XYZ", 1].unique_fails == 2 and out["p", "XYZ", 1].toxic_lost == 3 and out["q", "ZXY", 1].shapley == 18
    with pytest.raises(ValueError, match="every order"):
        fa.audit(counts, "ABCDEFGH")
