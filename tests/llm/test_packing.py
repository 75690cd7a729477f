import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from callsight.llm.packing import Limits, Packer, pack_documents
from callsight.llm.queries import tokenizer
from callsight.llm.tokens import Encoder

from .cases import no_docs, odd_docs, rows_of, small_docs

BPE = tokenizer("byte_bpe_50k.json")


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 20, pool=16), Limits(64, 64, 1, pool=50), Limits(100, 1, 100, pool=7), Limits(16, 4, 16, pool=1)])
def test_limits_hold_and_every_token_is_placed_once(limits):
    rng = random.Random(5)
    items = {k: (n := rng.choice([1, 2, 5, 30, 63, 64, 65, 150, 700]), rng.randint(0, n)) for k in range(300)}
    packer, pieces = Packer(limits), []
    for k, (n, loss_from) in items.items():
        pieces += packer.add(k, n, loss_from)
    pieces += packer.finish()
    placed, inside = defaultdict(list), defaultdict(list)
    for key, start, length, sequence, offset, segment, loss in pieces:
        assert length > 0 and loss == max(0, start + length - max(start, items[key][1]))
        placed[key].append((start, length))
        inside[sequence].append((offset, length, segment, loss))
    for k, (n, _) in items.items():
        at = 0
        for start, length in sorted(placed[k]):
            assert start == at
            at += length
        assert at == n
    for members in inside.values():
        members.sort()
        assert [m[0] for m in members] == list(np.cumsum([0, *(m[1] for m in members)])[:-1])
        assert [m[2] for m in members] == list(range(len(members)))
        assert sum(m[1] for m in members) <= limits.tokens and len(members) <= limits.segments
        assert sum(m[3] for m in members) <= limits.loss_tokens


def test_prompts_take_tokens_but_no_loss():
    packer = Packer(Limits(tokens=100, segments=10, loss_tokens=30))
    pieces = [p for k in range(4) for p in packer.add(k, 50, 40)] + list(packer.finish())
    assert sum(p[6] for p in pieces) == 40 and len({p[3] for p in pieces}) == 2


def check(docs, rows):
    encoder, texts = Encoder.of(BPE), rows_of(docs)
    expected = defaultdict(int)
    for doc, text in texts:
        expected[doc, encoder.direct(text or "") + b"\x01\0\0\0"] += 1
    total = defaultdict(int)
    for r in rows:
        own = [ids for (doc, ids) in expected if doc == r.doc_id and len(ids) == 4 * r.doc_tokens]
        assert any(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for ids in own)
        total[r.doc_id] += r.length
    want = defaultdict(int)
    for (doc, ids), n in expected.items():
        want[doc] += n * len(ids) // 4
    assert total == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for members in sequences.values():
        members.sort()
        size = 0
        for offset, length in members:
            assert offset == size
            size += length
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    return padding


def test_small_table(spark):
    docs = small_docs(spark)
    assert check(docs, pack_documents(docs, BPE).collect()) == 0


def test_defined_cases(spark):
    docs = odd_docs(spark)
    assert check(docs, pack_documents(docs, BPE).collect()) == 0
    assert pack_documents(no_docs(spark), BPE).count() == 0
