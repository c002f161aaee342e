from __future__ import annotations

import hashlib
import random

import numpy as np

from tests.llm.util import docs, prose
from tillpoint.llm import fingerprint as fp

ROWS = [(i * 7 % 1000, prose(i, (i * 31) % 200)) for i in range(150)] + [(2000, None), (2001, ""), (2002, "é"), (2003, "日本" * 4000), (-5, "x"), (2004, prose(3, 3000))]


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), t[:len(t) - half] + nxt[:half], nxt)
    return out


def test_edited_texts_and_fingerprints(spark):
    want = expected(ROWS)
    got = fp.compare(docs(spark, ROWS, extra=True).repartition(6)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        n, edited, nxt = want[r.doc_id]
        text = next(t or "" for d, t in ROWS if d == r.doc_id)
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fp.fingerprints([text, edited])
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(r.fingerprint, *fp.fingerprints([nxt]))


def test_layouts_agree_and_odd_tables(spark):
    a = sorted(map(str, fp.with_next(docs(spark, ROWS).repartition(1), fp._compare, fp.SCHEMA, buckets=1).collect()))
    b = sorted(map(str, fp.with_next(docs(spark, ROWS).repartition(8), fp._compare, fp.SCHEMA, buckets=40).collect()))
    assert a == b
    one = fp.compare(docs(spark, [(3, "alone here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.compare(docs(spark, [])).count() == 0
    same = fp.compare(docs(spark, [(1, "one text"), (1, "one text"), (None, "no id"), (1, "another")])).collect()
    assert len(same) == 4


def syncmers(text, k=fp.K, s=fp.S):
    """Which k-mers are closed syncmers, from each k-mer alone."""
    from tillpoint.llm.textscan import mix, powers
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    each = mix((codes + np.uint64(1)) * np.uint64(fp._STEP))
    h = lambda a: int(mix(np.array([np.sum(a * powers(fp._STEP, len(a)))], np.uint64))[0])
    out = set()
    for i in range(len(codes) - k + 1):
        inner = [h(each[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.add(f"{h(each[i:i + k]) >> 32:08x}")
    return out


def test_anchors_are_the_smallest_closed_syncmers():
    for text in (prose(1, 30), "ab" * 40, "é日x " * 25):
        got = fp.fingerprints([text])[0]
        assert [got[i:i + 8] for i in range(0, len(got), 12)] == sorted(syncmers(text))[:fp.ANCHORS]


def test_likeness_follows_the_share_of_common_text():
    r = random.Random(5)
    text = prose(8, 1500, 10 ** 6)
    assert fp.likeness(*fp.fingerprints([text, text])) == 1.0
    moved = "a new first line. " + text
    assert fp.likeness(*fp.fingerprints([text, moved])) > 0.8
    assert fp.likeness(*fp.fingerprints([text, prose(9, 1500, 10 ** 6)])) < 0.1
    w = text.split()
    w[r.randrange(len(w))] = "changed"
    assert fp.likeness(*fp.fingerprints([text, " ".join(w)])) > 0.8
    assert fp.likeness("", fp.fingerprints([text])[0]) == 0.0 and fp.likeness("", "") == 1.0
