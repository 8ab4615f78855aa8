"""The model of the quality rules against modified Kneser-Ney by its definition."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from nearprint.llm import rules
from tests.llm.data import documents, words

FOLD = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("\t\n\v\f\r ", " ")})


def published(texts: set[str]):
    """The longest n-grams by occurrences, the others by the signs they follow."""
    levels = {rules.ORDER: Counter(t[k : k + rules.ORDER] for t in texts for k in range(len(t) - rules.ORDER + 1))}
    for n in range(rules.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    taken, after = {}, {n: defaultdict(dict) for n in levels}
    for n, level in levels.items():
        n1, n2, n3, n4 = (max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        taken[n] = [max(0.1, min(k + 1.0, v)) for k, v in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        for g, c in level.items():
            after[n][g[:-1]][g] = c

    def p(gram: str) -> float:
        n = len(gram)
        if not n:
            return 1 / (len(levels[1]) + 1)
        if gram[:-1] not in after[n]:
            return p(gram[1:])
        seen = after[n][gram[:-1]]
        left = {g: c - taken[n][min(c, 3) - 1] for g, c in seen.items() if c >= (2 if n >= rules.PRUNED else 1)}
        total = sum(seen.values())
        return left.get(gram, 0.0) / total + (1 - sum(left.values()) / total) * p(gram[1:])

    return p


def corpus(spark):
    rng = random.Random(21)
    texts = [" ".join(words(rng, 90)) for _ in range(40)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate([*texts, *[texts[0]] * 30, "", None, "abc"])]
    return rows, spark.createDataFrame(rows, documents(spark).schema).repartition(5)


def test_longest_runs_are_counted_by_occurrences(spark):
    rows, docs = corpus(spark)
    p = published({(t or "").translate(FOLD) for _, t, *_ in rows})
    got = {r["doc_id"]: r for r in rules.apply(docs).collect()}
    found = {r["doc_id"]: (r["n_grams"], r["loss"]) for r in rules.scores(docs, rules.fit(docs, occurrences=True)).collect()}
    means = []
    for doc_id, text, *_ in rows:
        t = (text or "").translate(FOLD)
        grams = Counter(t[k : k + rules.ORDER] for k in range(len(t) - rules.ORDER + 1))
        loss = -sum(c * math.log(p(g)) for g, c in grams.items())
        assert found[doc_id][0] == sum(grams.values())
        assert math.isclose(found[doc_id][1], loss, rel_tol=1e-5, abs_tol=1e-4)
        if not got[doc_id]["base_failed"]:
            means.append((doc_id, loss, sum(grams.values())))
    # The verdict's losses are of this model.
    ordered = sorted(round(loss / n, 3) for _, loss, n in means)
    middle = (ordered[len(ordered) // 2] + ordered[(len(ordered) - 1) // 2]) / 2
    for doc_id, loss, n in means:
        drawn = (loss + rules.PRIOR_CHARS * middle) / (n + rules.PRIOR_CHARS)
        assert math.isclose(got[doc_id]["loss_per_char"], drawn, abs_tol=2.5e-3)


def test_counts_of_a_task_are_whole(monkeypatch):
    """Runs that are handed on early, merged or met again are counted once for each place."""
    import pyarrow as pa

    rng = random.Random(22)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(0, 60))) for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 7]), pa.array(["=x"] * len(texts[k : k + 7]))], ["text", "name"]) for k in range(0, 300, 7)]
    expected = Counter(t[k : k + 4] for t in texts for k in range(len(t) - 3))
    for held in (50, 500, 10**6):
        monkeypatch.setattr(rules, "HELD_RUNS", held)
        monkeypatch.setattr(rules.codes, "blocks", iter)
        got = Counter()
        for batch in rules._gather(4)(iter(batches)):
            for row in batch.to_pylist():
                got[row["gram"]] += row["many"]
        assert got == expected
