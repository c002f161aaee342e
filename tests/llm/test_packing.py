from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.util import docs, prose
from tillpoint.llm import packing, tokens
from tillpoint.llm.packing import Deal


def whole(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "a", "Don't STOP  the\tÉté's — “quotes” 1234½ ²", "ΑΣ ΟΔΟΣ İstanbul é <|endoftext|>  x\u0085y\u001cz",
       "日本語テキスト と 한국어", "x" * 3000, "don't we'll I'VE 'sup", prose(1, 9000), "é" * 70 + " ok", "́a b́", "ª º µ × ÷ ß ſ K"]


@pytest.mark.parametrize("text", ODD)
def test_chunk_ids_equal_the_whole_text(text):
    t = tokens.ChunkTokenizer(bound=3)
    assert np.frombuffer(t.ids(text or ""), t.width).tolist() == whole(text)


def check(rows, got, length):
    """Every id once, sequences gapless and full but the last."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, text, *_ in rows:
        ids = [*whole(text), 1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert bytes(r.ids) == part and zlib.crc32(part) >= 0
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == len(by_seq) - 1


def test_pack_covers_every_id_and_follows_the_mix(spark):
    rows = [(i, t, "odd") for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(i, 40 + 37 * (i % 11)), ["a", "b", None][i % 3]) for i in range(120)]
    got = packing.pack(docs(spark, rows, extra=True).repartition(7), length=256).collect()
    check(rows, got, 256)
    tokens_of = Counter()
    for r in got:
        tokens_of[r.queue] += r.length
    total = sum(tokens_of.values())
    for s in range(total // 256):
        mix = Counter()
        for r in got:
            if r.sequence_id == s:
                mix[r.queue] += r.length
        for q, n in tokens_of.items():
            assert abs(mix[q] - 256 * n / total) <= len(tokens_of) + 1


def test_weights_until_a_queue_runs_dry(spark):
    rows = [(i, prose(i, 300), "ab"[i % 2]) for i in range(20)]
    got = packing.pack(docs(spark, rows), weights={"a": 3, "b": 1}, length=128).collect()
    check(rows, got, 128)
    first = [r for r in got if r.sequence_id < 5]
    queue_a = next(r.queue for r in got if r.doc_id == 0)
    share = sum(r.length for r in first if r.queue == queue_a) / sum(r.length for r in first)
    assert abs(share - 0.75) < 0.03


def test_many_small_sources_share_a_queue(spark):
    rows = [(i, prose(i, 6), f"s{i}") for i in range(200)] + [(999, prose(5, 4000), "big")]
    check(rows, packing.pack(docs(spark, rows), length=64).collect(), 64)


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_deal_is_monotone_and_complete():
    deal = Deal([1000, 3, 70, 100000], [1.0, 5.0, 0.01, 2.0], 64)
    given = deal.after(np.arange(0, deal.all // 64 + 3))
    assert (np.diff(given) >= 0).all() and given[:, -1].tolist() == [1000, 3, 70, 100000] and given[:, 0].tolist() == [0] * 4
