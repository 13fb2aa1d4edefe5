import base64
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import bpe

P = pytest.importorskip("public_tokenizers")
FILE = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(FILE), "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(ranks, piece):
    """Merge the first pair of the lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def numbers_of(packed):
    return np.frombuffer(packed, dtype=np.int32).tolist()


def test_queue_gives_ranks_in_order():
    for size in (1, 256, 257, 70_000, 1 << 20):
        queue, chance, waiting = bpe.RankQueue(size), random.Random(size), {}
        for step in range(3000):
            if chance.random() < 0.6 or not waiting:
                rank = chance.randrange(size)
                queue.put(rank, step)
                waiting.setdefault(rank, []).append(step)
            else:
                rank = queue.least()
                assert rank == min(waiting)
                assert queue.take(rank) == waiting.pop(rank)
        while waiting:
            assert queue.take(queue.least()) == waiting.pop(min(waiting))
        assert queue.least() == -1 and not any(map(any, queue.levels))


def test_any_vocabulary_matches_plain_merging():
    """Also vocabularies in which a longer word ranks before its parts, and runs of one letter, where entries go stale."""
    for seed in range(60):
        chance = random.Random(seed)
        words = {bytes([c]) for c in b"abc"} | {bytes(chance.choices(b"abc", k=chance.randint(2, 6))) for _ in range(40)}
        numbers = list(range(len(words)))
        chance.shuffle(numbers)
        ranks = dict(zip(sorted(words), numbers, strict=True))
        coder = bpe.Coder(ranks)
        for _ in range(40):
            pieces = [bytes(chance.choices(b"abc", weights=(4, 1, 1), k=chance.randint(1, 60))) for _ in range(chance.randint(1, 5))]
            found = [numbers_of(ids) for ids in coder.encode(pieces)]
            assert found == [plain(ranks, piece) for piece in pieces]
            assert bytes(coder.decode(np.concatenate(found))[0]) == b"".join(pieces)


TEXTS = [
    "", " ", "\n\n  x", "Hello world, it's 12345 o'clock!", "naïve — café 日本語 🙂🙂 हिन्दी العربية", "a" * 3000, " " * 999 + "x", "<|endoftext|> is text",
    "word" * 700, "   mixed\tspace \r\n", "1234567890" * 50, "'s't're've'm'll'd", "x" * 100 + "é" * 500,
]


def test_matches_library(spark, ranks, library):
    chance = random.Random(5)
    letters = "abcdefghij  \n\t.,'0123éß日本🙂Ω"
    texts = TEXTS + ["".join(chance.choices(letters, k=chance.randint(1, 400))) for _ in range(300)]
    encoded = bpe.encoder(open(P.path(FILE), "rb").read(), P.PATTERN)
    for text, packed in zip(texts, encoded(texts), strict=True):
        assert numbers_of(packed) == library.encode_ordinary(text), text[:50]
    assert encoded(["", None]) == [b"", b""]


def test_memory_of_the_worker_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 30)
    known = bpe._Known(bpe.Coder(ranks))
    for at in range(30):
        words = [f"qx{at}w{i}zz" for i in range(15)] + ["y" * 100]
        assert [numbers_of(p) for p in known.packed([[w] for w in words])] == [plain(ranks, w.encode()) for w in words]
        assert len(known) <= 20 + 16


def test_long_pretoken_is_linear(ranks):
    coder = bpe.Coder(ranks)

    def seconds(n):
        piece = "".join(random.Random(1).choices("etaoin", k=n)).encode()
        began = time.process_time()
        assert bytes(coder.decode(np.frombuffer(coder.encode([piece])[0], dtype=np.int32))[0]) == piece
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.02)


def test_rows(spark, library, odd_docs, no_docs):
    out = bpe.encode(odd_docs.withColumn("token_ids", F.lit("kept")), P.path(FILE), P.PATTERN)
    assert out.columns == [*odd_docs.columns, "token_ids", "token_ids_"]
    rows = out.withColumn("back", bpe.decoded(spark, F.col("token_ids_"), P.path(FILE))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert list(r["token_ids_"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == (r["text"] or "").encode() and r["token_ids"] == "kept"
    assert bpe.encode(no_docs, P.path(FILE), P.PATTERN).collect() == []
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(bpe.decoded(spark, F.col("ids"), P.path(FILE)).alias("b"))
    assert sorted((r["b"] is None, bytes(r["b"] or b"")) for r in none.collect()) == [(False, b""), (True, b"")]


def test_vocabulary_is_bounded(spark, tmp_path, monkeypatch):
    file = tmp_path / "ranks"
    file.write_bytes(base64.b64encode(b"a") + b" 0\n")
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 3)
    with pytest.raises(ValueError, match="more than 3 bytes"):
        bpe.load_vocabulary(spark, str(file))


def test_a_worker_loads_no_pandas_and_splits_a_part_of_a_batch_at_once(ranks, monkeypatch):
    job = f"""
import sys, public_tokenizers as P
from gridcast.llm import bpe
run = bpe.encoder(open(P.path({FILE!r}), "rb").read(), P.PATTERN)
print(len(run(["a b c", None])), "pandas" in sys.modules)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", job], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert done.stdout == "2 False\n", done.stderr
    parts = []
    monkeypatch.setattr(bpe._Known, "packed", lambda self, pieces: parts.append(len(pieces)) or [b""] * len(pieces))
    assert len(bpe.encoder(b"YQ== 0", ".")(["a" * bpe.AT_ONCE, "a", None, "a" * bpe.AT_ONCE])) == 4
    assert parts == [1, 3, 0]


def test_frequent_pretokens_are_kept_when_others_go(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    known, learned = bpe._Known(bpe.Coder(ranks)), []
    monkeypatch.setattr(known, "learn", lambda words, learn=known.learn: learned.extend(words := sorted(words)) or learn(words))
    for at in range(40):
        known.packed([["frequentzz", *[f"qx{at}w{i}" for i in range(5)]]])
    assert learned.count("frequentzz") == 1


def test_buckets_merged_at_once_match_plain_merging(monkeypatch):
    """Buckets of every size, in vocabularies in which a longer word may rank before its parts; also words too long to prepare for."""
    for many, step, longest in ((1, 1 << 16, 256), (1, 7, 256), (5, 40, 256), (24, 1 << 16, 256), (1, 1 << 16, 4)):
        monkeypatch.setattr(bpe, "MANY", many)
        monkeypatch.setattr(bpe, "STEP", step)
        monkeypatch.setattr(bpe, "LONGEST", longest)
        for seed in range(20):
            chance = random.Random(seed)
            words = {bytes([c]) for c in b"abc"} | {bytes(chance.choices(b"abc", k=chance.randint(2, 6))) for _ in range(60)}
            order = sorted(words, key=lambda w: (len(w) if seed % 2 else 0, chance.random()))
            ranks = {word: rank for rank, word in enumerate(order)}
            coder = bpe.Coder(ranks)
            pieces = [bytes(chance.choices(b"abc", weights=(chance.choice((1, 6)), 1, 1), k=chance.randint(1, 40))) for _ in range(150)]
            assert [numbers_of(ids) for ids in coder.encode(pieces)] == [plain(ranks, piece) for piece in pieces]
            assert not any(map(any, coder.queue.levels)) and not coder.queue.buckets


def test_rare_pretokens_cost_few_lookups(ranks):
    class Counted(dict):
        lookups = 0

        def get(self, *args):
            Counted.lookups += 1
            return super().get(*args)

    parts = "an en er in on re st th ou ing tion ble sh ly ed wh ha at".split()
    chance = random.Random(3)
    words = sorted({" " + "".join(chance.choices(parts, k=4)) for _ in range(20_000)})
    coder = bpe.Coder(Counted(ranks))
    coder.encode([b"ab" * 50])
    Counted.lookups = 0
    pieces = [word.encode() for word in words]
    found = coder.encode(pieces)
    assert Counted.lookups < 2 * len(words)
    assert [numbers_of(ids) for ids in found[::50]] == [plain(ranks, piece) for piece in pieces[::50]]


def test_long_pretokens_are_not_remembered(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    known = bpe._Known(bpe.Coder(ranks))
    for at in range(30):
        text = ["short", "qx" * 100 + str(at), "short"]
        assert numbers_of(known.packed([text, []])[0]) == [i for word in text for i in plain(ranks, word.encode())]
        assert list(known) == ["short"] and len(known.ids) < 16 * 20 + 300
