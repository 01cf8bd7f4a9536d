import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import crosstoken
from tests.llm.fixtures import awkward, empty, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> and <s> and </s> <unk>", " leads", "trails ", "two  spaces", "a▁b", "ﬁ é　x", "tab\tline\nfeed\r\n", "\U0001f600‍\U0001f600", "café naïve 12,345. x", "\x00nul", " "]


def plain(rows):
    """The contract, token by token."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    alphabet = crosstoken.byte_level_alphabet()
    out, counts = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelled_a = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for spelled in (spelled_a, spelled_b):
            at, own = 0, []
            for x in spelled:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, own) if start < x[1] <= end) for ids, own in zip((a, b), spans)))
            start = end
        counts.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(map(repr, [(d, x, y, g, len(k), sum(counts[i] == most[i[1]] for i in k), sum(counts[i] for i in k), h) for d, x, y, g, k, h in out]))


def test_same_as_token_by_token(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i, 5 * i)) for i in range(20)] + [(7, None), (None, "x"), (9, ""), (9, "same row"), (9, "same row"), (50, prose(1, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (8 << 20, 2_000):
        monkeypatch.setattr(crosstoken, "BLOCK_BYTES", block)
        assert sorted(repr(tuple(r)) for r in crosstoken.align(docs).collect()) == plain(rows)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = crosstoken.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert len(rows) == docs.count() and sorted(map(repr, (tuple(r)[:1] for r in rows))) == sorted(map(repr, (tuple(r)[:1] for r in docs.collect())))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows) and max(r.n_a for r in rows) > 30_000
    assert crosstoken.align(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return crosstoken.PieceEncoder(PATHS[1], memory=40)


WORD = st.text(st.sampled_from("ab eZ.,'\n\t▁é 中\U0001f600<s>"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=6))
def test_pieces_are_the_library_s(pieces, texts):
    ids, counts = pieces.encode(pa.array(texts, pa.string()))
    whole = [pieces.model.encode(t) for t in texts]
    assert ids.tolist() == [i for x in whole for i in x] and counts.tolist() == [len(x) for x in whole]


@settings(max_examples=100, deadline=None)
@given(st.lists(WORD, max_size=6))
def test_spaced_bytes_are_the_library_s(texts):
    encoder = crosstoken.tokenizers_of(*PATHS).a
    ids, counts = encoder.encode(pa.array(texts, pa.string()), spaced=True)
    whole = [encoder.tokenizer.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in whole for i in x] and counts.tolist() == [len(x) for x in whole]
