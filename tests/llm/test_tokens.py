import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stratalex.llm import packing, token_store
from stratalex.llm.common import scratch_path
from stratalex.llm.tokens import Encoder

NAME = "byte_bpe_50k.json"
TEXTS = ["", "a", "Hello, world!  Two  spaces", "line\nline\n\n end \n", "don't won't 'sup it's", "été çà Ébauche naïve", "x y z  q", "tabs\tand\r\n more", "<|endoftext|> inside", "日本語 テキスト 😀 👍🏽", "a,b.c;d 'quoted' \"q\" (x)", "0123 45.6e-7 ١٢٣", "w" * 5000, "\x1c a \x85 b", " lead", "trail ", "\n", "é combining", "ɏa ʰb"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_encoder_equals_library(tokenizer, words):
    own = Encoder(NAME)
    texts = TEXTS + [" ".join(words(i, 200)) for i in range(20)]
    got = [np.frombuffer(b, "<u2").tolist() for b in own.encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_random_texts(tokenizer, monkeypatch):
    from stratalex.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)  # generations change all the time
    own, rng = Encoder(NAME), random.Random(1)
    parts = [*" \n\t ab,.'sé\r\u00a0\u3000日1٣<|!x-ʰ", "'s", "'ll", "<|endoftext|>", "  ", "\n\n", "word", " the", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(5000)]
    for text, b in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def rows(words):
    out = [(10 * i, t) for i, t in enumerate(TEXTS)]
    return out + [(5, None), (10, "a"), (10, "b"), (None, "none"), (None, None), (999, " ".join(words(1, 9000)))]


def test_store_round_trip(spark, make_docs, words, tokenizer):
    data = rows(words)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.store_digest(spark, make_docs(data), NAME, 2).collect())
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t in data), key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64(x[1].encode(), 42).intdigest()).view(np.int64))):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_store_lookup(spark, make_docs, tokenizer):
    manifest = token_store.write_store(make_docs([(i * 7, f"text {i}") for i in range(300)]), scratch_path(spark, "t"), NAME, 2)
    for i in (0, 1, 150, 299):
        assert token_store.get_ids(manifest, i * 7) == tokenizer.encode(f"text {i}").ids + [2]
    assert token_store.get_ids(manifest, 3) is None


def test_one_id_in_many_shards(spark, make_docs, tokenizer):
    """Rows of one id, or of none, and equal rows go over the shards; each has an entry of its own."""
    data = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i % 40}") for i in range(400)] + [(8, "same")] * 200
    manifest = token_store.write_store(make_docs(data), scratch_path(spark, "t"), NAME, 2)
    keys = [(r.id, r.seq) for r in manifest["entries"].collect()]
    assert len(set(keys)) == len(keys) == 900 and {i: max(s for j, s in keys if j == i) for i in (7, None, 8)} == {7: 299, None: 399, 8: 199}
    got = Counter(bytes(r.ids) for r in token_store.read_store(manifest["entries"], manifest).collect())
    assert got == Counter(np.array(tokenizer.encode(t).ids + [2], "<u2").tobytes() for _, t in data)
    assert {tuple(token_store.get_ids(manifest, 7, k)) for k in range(300)} == {(*tokenizer.encode(f"text {i}").ids, 2) for i in range(300)}
    assert token_store.get_ids(manifest, 7, 300) is None and token_store.get_ids(manifest, None, 399) is not None


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).permutation(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        table = token_store.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
        cells = np.zeros(n, token_store._SLOT)
        cells["mark"][table.slots(keys)], cells["first"][table.slots(keys)] = token_store._mark(keys), np.arange(n)
        file = io.BytesIO(table.dump() + cells.tobytes())
        assert all(token_store._find_one(file, keys[i : i + 1])["first"] == i for i in range(0, n, 997))
        assert all(token_store._find_one(file, np.array([x], np.uint64)) is None for x in (1, 2, 3))
    again = token_store.PerfectHash.load(io.BytesIO(table.dump()))
    assert (again.slots(keys) == table.slots(keys)).all()


def test_empty_tables(spark, make_docs):
    assert token_store.store_digest(spark, make_docs([]), NAME, 2).count() == 0
    assert packing.best_fit(make_docs([]), NAME, 0).count() == 0


def test_packing(make_docs, words, tokenizer):
    data = rows(words) + [(2000 + i, " ".join(words(i, 20 + 37 * i % 900))) for i in range(120)]
    got = packing.best_fit(make_docs(data), NAME, 0).collect()
    want, total = Counter(), 0
    for i, t in data:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        cuts = [0] if len(ids) <= 2048 else [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, at in enumerate(cuts):
            part = ids[at : [*cuts, len(ids)][k + 1]]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= total / 2048 * 1.03 + 1


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                at = rooms.index(r)
                place(k + 1, rooms[:at] + [r - lengths[k]] + rooms[at + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def searched(lengths, capacity):
    bins = packing.Bins(capacity)
    bins.fill(list(lengths))
    start, fill = bins.used, sum((capacity - r) ** 2 for r in bins.room)
    bins.improve()
    assert sorted(i for x in bins.items for _, i in x) == list(range(len(lengths)))
    assert all(sum(n for n, _ in x) == capacity - r for x, r in zip(bins.items, bins.room, strict=True)) and min(bins.room, default=0) >= 0
    assert sum((capacity - r) ** 2 for r in bins.room) >= fill
    return start, bins.used, bins.exchanges


def test_local_search_against_the_optimum():
    rng, gap, emptied = random.Random(5), 0, 0
    for _ in range(300):
        lengths = [rng.randrange(2, 14) for _ in range(rng.randrange(1, 12))]
        start, end, _ = searched(lengths, 20)
        least = fewest(lengths, 20)
        assert least <= end <= start
        gap, emptied = gap + end - least, emptied + start - end
    assert emptied > 10 and gap <= 3


def test_local_search_empties_bins():
    rng = np.random.default_rng(1)
    for low, high in ((300, 1400), (600, 760), (1, 2048)):
        lengths = rng.integers(low, high, 3000)
        start, end, exchanges = searched(lengths.tolist(), 2048)
        assert exchanges > 100 and end < start
        if high < 2048:
            assert end <= 1.01 * lengths.sum() / 2048 + 1
    assert searched([6, 5, 4, 4, 1], 10)[1] == 2
    assert searched([], 10) == (0, 0, 0)
