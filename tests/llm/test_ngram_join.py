"""The n-gram join against all pairs."""

import random

import pytest
from cases import DOCUMENTS, documents, frame, prose

from shopstream.llm import ngram_join
from shopstream.llm.word_arrays import word_hashes


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        k = top(i)
        ids = [x for x in (least.get(k), r[0]) if x is not None]
        least[k] = min(ids) if ids else None
    return sorted(((r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(rows)), key=repr)


def joined(df, n, percent):
    got = ngram_join.ngram_jaccard_join(df, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_same_components_as_all_pairs(spark, n, percent, seed):
    rows = documents(seed)
    assert joined(frame(spark, rows, extra=True), n, percent) == brute(rows, n, percent)


def test_small_chunks_hot_ngrams_and_blocks(spark, monkeypatch):
    """The same with many chunks, n-grams that count as hot, and families of several blocks."""
    rng = random.Random(5)
    base = prose(rng, 80).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(60)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    rows += [(100 + i, prose(rng, 30) + " " + " ".join(base[:20]), "en", "a", 0) for i in range(20)]
    df = frame(spark, rows)
    sent = ngram_join.Sender.messages.__globals__
    monkeypatch.setitem(sent, "HOT", 3)
    monkeypatch.setitem(sent, "CHUNK_GRAMS", 900)
    monkeypatch.setitem(sent, "BLOCK", 7)
    assert joined(df, 3, 80) == brute(rows, 3, 80)
    assert joined(df, 3, 90) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert joined(spark.createDataFrame([], DOCUMENTS), 3, 90) == []


def test_one_of_each_keeps_one_row_per_component(spark):
    rows = documents(3)
    kept = ngram_join.one_of_each(frame(spark, rows), 5, 80).collect()
    ids = [tuple(r) for r in kept]
    assert len(ids) == len(set(ids)) or {i for i in ids if ids.count(i) > 1} <= {i for i in ids if not shingles(i[1], 5)}
    sets = [shingles(r["text"], 5) for r in kept]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not (a and b and 100 * len(a & b) >= 80 * len(a | b))
    components = {c for i, n, c in brute(rows, 5, 80) if n}
    assert {r["doc_id"] for r in kept if shingles(r["text"], 5)} == components


def test_words_are_hashed_one_by_one():
    import pyarrow as pa
    texts = ["One two\tONE", None, "", "x", "  x  ", "é\x0bÉ x", "two\n" * 5]
    got = {}
    for first, hashes, offsets in word_hashes(pa.array(texts)):
        for k in range(len(offsets) - 1):
            got[first + k] = hashes[offsets[k]:offsets[k + 1]].tolist()
    assert [len(got[i]) for i in range(len(texts))] == [3, 0, 0, 1, 1, 3, 5]
    assert got[0][0] == got[0][2] != got[0][1] == got[6][0]
    assert got[3] == got[4] and got[5][2] == got[3][0] and got[5][0] != got[5][1]
