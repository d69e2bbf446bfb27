"""op10 against its contract, with hashes, shingles, majority and links worked out apart from the module."""

import random
import re

import xxhash

from comuna.llm import queries
from comuna.llm.simhash import simhash_components


def contract(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_is_its_contract(spark, tmp_path):
    rng = random.Random(21)
    pool = "Rain river STONE letter window ñandú garden éter silver a b c d e 1 2".split()
    texts = [None, "", " \t\n", "One", "one two THREE", "ÀÉ Ñ À É"]
    for _ in range(40):
        words = [rng.choice(pool) + str(rng.randrange(400)) for _ in range(rng.choice([3, 4, 5, 60, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            changed = list(words)
            changed[rng.randrange(len(words))] = "other"
            texts.append(rng.choice([" ", "\t", "\n\n"]).join(changed))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    prints = {i: contract(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, f"file://{tmp_path}").collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in prints} and len(set(root(i) for i in prints)) < len(prints) - 10
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string"), words=4, radius=4).count() == 0
