import random

import corpus_pipeline
from lectern.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """Smallest id of each row's group, by comparing all with all."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))


def table():
    rng, texts = random.Random(11), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        texts.append(" ".join(words))
        for changed in (1, 2, 3, 5, 9):
            other = list(words)
            for _ in range(changed):
                other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(other))
    texts += ["", None, " ", "one", "One", texts[0], texts[3].upper()]
    return [(i, t) for i, t in enumerate(texts)]


def test_groups_match_brute_force(spark):
    rows = table()
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute(rows)


def test_pipeline_stage_drops_documents_with_changed_words(spark):
    words = [f"w{i}" for i in range(200)]
    changed = [w if i not in (20, 80, 140) else "other" for i, w in enumerate(words)]
    far = [w if i % 10 else "else" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((words, changed, far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()) == [0, 2]


def test_large_groups_of_near_copies_lose_no_link(spark):
    """Few words, many edits: documents apart by one bucket, by rare shingles and by common ones."""
    rng = random.Random(2)
    base, rows = [f"b{i}" for i in range(60)], []
    for _ in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(6)}"
        if rng.random() < 0.3:
            words = words[: rng.randint(30, 60)]
        rows.append((len(rows), " ".join(words)))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == want and 5 < len({c for _, c in want}) < 250


def template(n, changed, seed):
    """Pages of one template with some of 40 blocks of their own; some change the same blocks, and a few are one another's copies."""
    rng, rows = random.Random(seed), []
    blocks = [" ".join(f"t{i}_{j}" for j in range(8)) for i in range(40)]
    for d in range(n):
        page, at = list(blocks), rng.sample(range(40), changed) if d % 3 else rng.sample(range(5), min(5, changed))
        for i in at:
            page[i] = " ".join(f"d{d}_{i}_{j}" for j in range(8))
        if d % 11 == 5:
            page = rows[-1][1].split("\n")
            page[rng.randrange(40)] = f"one other line {d}"
        rows.append((d, "\n".join(page)))
    return rows


def test_pages_of_one_template_match_brute_force(spark, monkeypatch):
    made, staged = [], near_copies.staged
    monkeypatch.setattr(near_copies, "LARGE", 8)
    monkeypatch.setattr(near_copies, "DENSE", 2)
    monkeypatch.setattr(near_copies, "staged", lambda df, name: (lambda out: (made.append(out.count()) if name == "rest" else None, out)[1])(staged(df, name)))
    for changed in (3, 5):
        rows = template(160, changed, changed)
        got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = brute(rows)
        assert sorted((r.doc_id, r.component_id) for r in got) == want and 2 < len({c for _, c in want}) < 160
    assert made[-1] < 160 * 159 / 2 / 4


def test_a_large_group_makes_few_pairs_a_member_and_hands_on_one_link_each(spark, monkeypatch):
    """The centre of many buckets is one row, and rounds join components, not all links found."""
    made, linked, staged, components = [], [], near_copies.staged, near_copies.connected_components
    monkeypatch.setattr(near_copies, "staged", lambda df, name: (lambda out: (made.append(out.count()) if name in ("pairs", "rest") else None, out)[1])(staged(df, name)))
    monkeypatch.setattr(near_copies, "connected_components", lambda edges: (linked.append(edges.where("a <> b").distinct().count()), components(edges))[1])
    n, rng, base, rows = 300, random.Random(300), [f"w{i}" for i in range(150)], []
    for d in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 5)):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words)))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute(rows)
    assert sum(made) < 18 * n and max(linked) < 3 * n, (made, linked)
