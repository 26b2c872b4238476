"""The pipeline's near-dedup stage against the Jaccard similarity of all pairs, with groups larger than a cell compared at once."""

import random

import corpus_pipeline


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_by_jaccard(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    made = lambda n: [word() for _ in range(n)]
    texts = []
    for k in range(120):  # 1 to 6 words of 100 or 200 changed: similarities on both sides of 0.8
        words = made(100 + 100 * (k % 2))
        other = list(words)
        for at in rng.sample(range(len(words)), 1 + k % 6):
            other[at] = word()
        texts += [" ".join(words), " ".join(other).upper()]
    base = made(150)
    for _ in range(60):  # one large group
        near = list(base)
        near[rng.randrange(150)] = word()
        near[rng.randrange(150)] = word()
        texts.append(" ".join(near))
    texts += [texts[0], None, "", " \n ", "one", "ONE", "one two"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda k: k if root[k] == k else find(root[k])
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                near += 0 < shared < len(sets[i] | sets[j])
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, "")
    assert kept.columns == df.columns and near > 100
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(k) for k in root})
    assert corpus_pipeline.minhash.keep_first(df.limit(0)).count() == 0
