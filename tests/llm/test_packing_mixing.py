"""Packing and mixing."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import mixing, packing, pretokens
from codelode.llm.pretokens import chunk_ids, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab é\n\t  　\x1c\x85!1'字<|>", "<|endoftext|>", "<|endof"]), max_size=40).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_those_of_the_tokenizer, "t") else test_ids_are_those_of_the_tokenizer.t
    test_ids_are_those_of_the_tokenizer.t = t
    assert np.frombuffer(encode(text, chunk_ids(PATH)), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_texts_meet_the_tokenizer_once_and_long_ones_by_chunks(tokenizer, monkeypatch):
    known = pretokens.ChunkIds(PATH)
    calls, whole = [], known.encode
    known.encode = lambda text: calls.append(text) or whole(text)
    text = "\n".join(f"w{i:x} {i * 7919:x}\t  z{i}\x1c" for i in range(500))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text, known), "<u4").tolist() == ids and len(calls) == 1
    assert np.frombuffer(encode(f"{text}<|endoftext|>{text}", known), "<u4").tolist() == [*ids, int.from_bytes(known.added["<|endoftext|>"], "little"), *ids] and len(calls) == 3
    monkeypatch.setattr(pretokens, "WHOLE_CHARS", 100)
    for t in (text, text.replace("\t  ", " ")):
        assert np.frombuffer(encode(t, known), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert max(map(len, calls[3:])) < 100


def test_pieces_and_places(docs, rows, tokenizer):
    got = packing.pack(docs, PATH, capacity=64, groups=8, small=28).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        n = len(ids) // 4
        first = (n - 1) % 64 + 1
        cuts = [0, *range(first, n + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 3


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), min_size=1, max_size=40))
def test_plans_place_everything_once(histogram):
    runs = packing.plan(histogram, 100, 8, 40)
    room, used = defaultdict(list), Counter()
    for n, first, number, sequence, offset in runs:
        assert first == used[n]
        used[n] += number
        for s in range(sequence, sequence + number):
            room[s].append((offset, n))
    assert used == Counter(histogram)
    for parts in room.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 100
    plain = packing.Bins(100)
    for n in sorted(histogram, reverse=True):
        plain.best_fit(n, histogram[n])
    assert len(room) <= 1.1 * sum(c for k in plain.by_room.values() for _, c in k) + 4


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    assert mixing.mix(no_docs, mixing.repeating_weights(no_docs)).count() == 0


def test_targets_and_copies(docs, rows):
    got = mixing.mix(docs, mixing.repeating_weights(docs)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w])
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= share
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in order:
        smallest = min([r.size for r in got if r.source == s and r.size], default=0)
        assert abs(taken[s] - target[s]) <= smallest
    again = mixing.mix(docs, mixing.repeating_weights(docs)).collect()
    assert sorted((r.row, r.copies) for r in got) == sorted((r.row, r.copies) for r in again)


def test_draws_do_not_depend_on_the_layout(spark):
    """The same rows in other files and another order: the same documents are taken, as often. Some have no doc_id."""
    rows = [(i if i % 5 else None, " ".join(f"w{i * k % 97}" for k in range(1 + i % 9)), f"s{i % 3}") for i in range(900)]
    taken = []
    for files in (1, 7):
        df = spark.createDataFrame(rows if files == 1 else rows[::-1], "doc_id long, text string, source string").repartition(files)
        out = mixing.mix(df, mixing.repeating_weights(df), share=1.3, keep=["text"]).select("doc_id", "kept.text", "copies").collect()
        taken.append(Counter((r.doc_id, r.text, r.copies) for r in out))
    assert taken[0] == taken[1] and len({c for _, _, c in taken[0]}) > 1


def test_ranked(spark):
    got = mixing.ranked(spark.range(1000).selectExpr("cast(id * 7 % 1000 as string) as k").repartition(5), "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == sorted(str(i) for i in range(1000))
