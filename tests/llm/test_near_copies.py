"""Near copies against all pairs."""

import random
from collections import Counter

SF = "/root/testdata/sf0.01"


def test_near_copies(spark):
    from latticework.llm.minhash_join import near_copies, one_of_each

    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    made = []
    for g in range(12):
        base = [word() for _ in range(r.choice([3, 8, 60, 300]))]
        for c in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(len(w) * r.choice([0, 1, 2, 4, 9]) // 400):
                w[r.randrange(len(w))] = word()
            made.append(" ".join(w))
    base = [word() for _ in range(200)]
    for c in range(700):  # more than a block of different near copies
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = word()
        made.append(" ".join(w))
    made += [made[-1]] * 40 + [None, None, "", " ", "hi there", "hi there"]
    ids = list(range(len(made)))
    sets = [None if not t or not t.split() else {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in made]
    links, texts, up = [0] * len(made), [set() for _ in made], list(range(len(made)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    inverse = {}
    for i, s in enumerate(sets):
        seen = Counter(j for x in s or () for j in inverse.get(x, ()))
        for j, n in seen.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                if made[i] != made[j]:
                    texts[i].add(made[j])
                    texts[j].add(made[i])
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for x in s or ():
            inverse.setdefault(x, []).append(i)
    df = spark.createDataFrame(list(zip(ids, made, strict=True)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in near_copies(df).collect()}
    assert len(got) == len(made)
    wrong = [i for i in ids if got[i]["class_id"] != top(i) or got[i]["n_links"] != links[i] or got[i]["n_linked_texts"] != len(texts[i])]
    assert not wrong, [(i, got[i]["class_id"], top(i), got[i]["n_links"], links[i]) for i in wrong[:9]]
    kept = [x["doc_id"] for x in one_of_each(df.unionByName(df.where("doc_id < 3"))).collect()]
    assert sorted(set(kept)) == sorted({top(i) for i in ids}) and len(kept) == len(set(kept))


def pairs_of(texts, words=5, similarity=0.8):
    """All pairs of different texts at or above the similarity, through every shared shingle."""
    split = [t.split() for t in texts]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in split]
    inverse, out = {}, set()
    for i, s in enumerate(sets):
        seen = Counter(j for x in s for j in inverse.get(x, ()))
        out |= {(j, i) for j, n in seen.items() if n >= similarity * (len(s) + len(sets[j]) - n)}
        for x in s:
            inverse.setdefault(x, []).append(i)
    return out


def test_recall_on_a_table(spark):
    """Every link between different texts of the documents at hand, by the numbers of linked texts."""
    from latticework.llm.minhash_join import near_copies

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = sorted({r["text"] for r in d.collect() if r["text"] and r["text"].split()})
    want = Counter()
    for a, b in pairs_of(texts):
        want[texts[a]] += 1
        want[texts[b]] += 1
    got = {r["text"]: r["n_linked_texts"] for r in near_copies(d).collect() if r["text"] and r["text"].split()}
    found = sum(got.values())
    assert all(got[t] <= want[t] for t in texts) and found >= 0.99 * sum(want.values()) > 0


def test_other_columns_and_no_rows(spark):
    from latticework.llm.minhash_join import near_copies, one_of_each

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, *"abcdefg"), (2, base + " more", *"abcdefg"), (3, None, *"abcdefg"), (4, "", *"abcdefg"), (1, base, *"abcdefg")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n string, links string, texts string, worded string, fp string, `a.b` string, class_id string")
    got = near_copies(d).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_linked_texts"]) for r in got) == [(1, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 0, 0), (4, 4, 0, 0)]
    assert all((r["n"], r["links"], r["texts"], r["worded"], r["fp"], r["a.b"]) == tuple("abcdef") for r in got)
    assert near_copies(d.limit(0)).count() == 0 and one_of_each(d.limit(0)).count() == 0
    kept = one_of_each(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_components_of_a_hub_and_chains(spark):
    """A node with most of the edges, chains, and pairs: the least node of each component, as by a plain search."""
    import random

    from latticework.llm.minhash_join import components

    r = random.Random(5)
    edges = [(5000, 5001 + i) for i in range(3000)] + [(100 + i, 101 + i) for i in range(40)] + [(9000 + 2 * i, 9001 + 2 * i) for i in range(50)] + [(8000, 120), (7, 7)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in edges]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: top(n) for n in up if n != 7}  # an edge from a node to itself links nothing
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stored_rounds_release_what_the_driver_held(spark):
    """After each stored round the driver frees the plans and broadcasts behind it; the rows stay."""
    from latticework.llm.common import stored

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    before = sum(b.getCollectionCount() for b in old)
    assert sorted(r.id for r in stored(spark.range(5), "five").collect()) == [0, 1, 2, 3, 4]
    assert sum(b.getCollectionCount() for b in old) > before
