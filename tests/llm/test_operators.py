"""Every operator against brute force on a small table, and on an empty one."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from nearprint.llm import fingerprints, idstore, lines, mixing, neardup, packing, rules, substrings, suffixes
from nearprint.llm.tokens import tokenizer_path
from tests.llm.data import WORD, documents, order, rows, words

ROWS = rows()


def collected(df):
    return [tuple(r) for r in df.collect()]


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def found_words(text):
    return WORD.findall(text or "")


def covered(units: list, window: int) -> list[bytearray]:
    first: dict = {}
    for (doc_id, *_), unit in zip(ROWS, units, strict=True):
        for k in range(len(unit) - window + 1):
            w = unit[k : k + window]
            first[w] = min(first.get(w, order(None)), order(doc_id))
    out = []
    for (doc_id, *_), unit in zip(ROWS, units, strict=True):
        marks = bytearray(len(unit))
        for k in range(len(unit) - window + 1):
            if first[unit[k : k + window]] < order(doc_id):
                marks[k : k + window] = b"\1" * window
        out.append(marks)
    return out


def test_substring_dedup(spark):
    units = [tuple(found_words(r[1])) for r in ROWS]
    expected = Counter(
        (r[0], len(u), sum(m), sha(" ".join(w for w, gone in zip(u, m, strict=True) if not gone)))
        for r, u, m in zip(ROWS, units, covered(units, 50), strict=True)
    )
    assert sum(e[2] for e in expected) > 0
    assert Counter(collected(substrings.digest(documents(spark, extra=True)))) == expected
    texts = collected(substrings.dedup(documents(spark)))
    assert Counter((i, n, gone, sha(t)) for i, n, gone, t in texts) == expected


def test_suffix_dedup(spark):
    units = [(r[1] or "").encode() for r in ROWS]
    expected = Counter()
    for r, u, m in zip(ROWS, units, covered(units, 50), strict=True):
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        expected[r[0], len(u), sum(m), spans, sha(bytes(b for b, gone in zip(u, m, strict=True) if not gone))] += 1
    assert Counter(collected(suffixes.digest(documents(spark, extra=True)))) == expected
    spans = [(r["doc_id"], r["n_removed"], sum(e - s for s, e in zip(r["span_starts"], r["span_ends"], strict=True))) for r in suffixes.dedup(documents(spark)).collect()]
    assert all(n == total for _, n, total in spans)


def test_hot_minimisers_are_cut_into_windows(spark, monkeypatch):
    from nearprint.llm import windows

    monkeypatch.setattr(windows, "HOT_RUNS", 2)
    test_substring_dedup(spark)


def shingles(text) -> frozenset:
    w = found_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(sets: list[frozenset]) -> dict:
    parent = {order(r[0]): order(r[0]) for r in ROWS}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(order(ROWS[i][0])), find(order(ROWS[j][0]))))
                parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("short", [16, 1])
def test_near_duplicates(spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    sets = [shingles(r[1]) for r in ROWS]
    reached = near_groups(sets)
    blank = lambda x: None if x == order(None) else x
    expected = Counter()
    for r, s in zip(ROWS, sets, strict=True):
        own = order(r[0])
        label = reached[own] if s else own
        expected[r[0], len(s), blank(label), own == label] += 1
    assert Counter(collected(neardup.groups(documents(spark, extra=True)))) == expected
    kept = {r["doc_id"] for r in neardup.keep_one(documents(spark)).collect()}
    assert kept == {e[0] for e in expected if e[3]}


@pytest.mark.parametrize(("percent", "floor", "most"), [(neardup.PERCENT, neardup.FLOOR, 1e-8), (corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_FLOOR, 3e-8)])
def test_sketches_lose_no_link(percent, floor, most):
    p, least = percent / 100, math.ceil(floor * neardup.K)
    assert sum(math.comb(neardup.K, k) * p**k * (1 - p) ** (neardup.K - k) for k in range(least)) < most


def test_line_dedup(spark):
    by_id = defaultdict(list)
    for r in ROWS:
        by_id[order(r[0])].append(r)
    seen: set = set()
    expected = Counter()
    for key in sorted(by_id):
        new = set()
        for doc_id, text, *_ in by_id[key]:
            split = text.split("\n") if text is not None else []
            used = [k for k, line in enumerate(split) if WORD.search(line)]
            gone, own = set(), set()
            for k in range(len(used) - 2):
                w = tuple(split[j] for j in used[k : k + 3])
                gone.update(used[k : k + 3] if w in seen or w in own else ())
                own.add(w)
            new |= own
            left = None if text is None else "\n".join(line for k, line in enumerate(split) if k not in gone)
            expected[doc_id, left, len(split), len(gone)] += 1
        seen |= new
    got = lines.dedup(documents(spark, extra=True)).select("doc_id", "text", "n_lines", "n_removed")
    assert Counter(collected(got)) == expected
    assert sum(e[3] for e in expected) > 0


def test_quality_rules(spark):
    got = collected(rules.apply(documents(spark, extra=True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        w = found_words(text)
        seen, repeated = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        under = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(under) > 50 * len(w)
        expected[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(under), failed] += 1
    assert Counter(g[:7] for g in got) == expected
    assert not any(g[7] for g in got if g[6]) and any(g[7] for g in got)


def kneser_ney(runs: set[str], order: int, pruned: int):
    """The probability of a sign after others, straight from the definition."""
    levels = {order + 1: runs}
    for n in range(order, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    del levels[order + 1]
    taken = {}
    for n, level in levels.items():
        n1, n2, n3, n4 = (max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        taken[n] = [max(0.1, min(k + 1.0, v)) for k, v in enumerate(d)]

    def p(gram: str) -> float:
        n = len(gram)
        if not n:
            return 1 / (len(levels[1]) + 1)
        after = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        least = 2 if n >= pruned else 1
        left = {g: c - taken[n][min(c, 3) - 1] for g, c in after.items() if c >= least}
        total = sum(after.values())
        return left.get(gram, 0.0) / total + (1 - sum(left.values()) / total) * p(gram[1:])

    return p


def test_kneser_ney_as_defined(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdeé", [9, 7, 5, 3, 1, 1], k=700))
    runs = {text[k : k + 4] for k in range(len(text) - 3)}
    rows = [(name, gram) for name in ("=x", "") for gram in runs]
    got = rules.probabilities(spark.createDataFrame(rows, "name string, gram string"), order=3, pruned=3).collect()
    model = {r["gram"]: (r["logp"], r["off"]) for r in got if r["name"] == ""}
    assert {r["gram"]: (r["logp"], r["off"]) for r in got if r["name"] == "=x"} == model

    def p(gram: str) -> float:
        logp, _ = model.get(gram, (None, 0.0))
        return math.exp(logp) if logp is not None else math.exp(model.get(gram[:-1], (None, 0.0))[1]) * p(gram[1:])

    defined = kneser_ney(runs, 3, 3)
    signs = sorted(set(text))
    for context in [a + b for a in signs for b in signs]:
        for sign in signs:
            assert math.isclose(p(context + sign), defined(context + sign), rel_tol=1e-9)
        assert math.isclose(sum(p(context + sign) for sign in [*signs, "?"]), 1, rel_tol=1e-9)


def test_losses_are_those_of_the_model_and_the_same_by_parts(spark):
    rng = random.Random(6)
    rows = [*ROWS, *((5000 + k, " ".join(words(rng, 80)), rng.choice(["en", "fr", None]), "a", 1) for k in range(60))]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    model = rules.fit(docs)
    sent, parted = (collected(rules.scores(docs, model, sent_rows=n)) for n in (10**9, 0))
    assert Counter(sent) == Counter(parted) and len(sent) == len(rows)
    fold = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("\t\n\v\f\r ", " ")})
    by_lang = defaultdict(set)
    for _, text, lang, *_ in rows:
        t = (text or "").translate(fold)
        by_lang[lang].update(t[k : k + rules.ORDER + 1] for k in range(len(t) - rules.ORDER))
    defined = {lang: kneser_ney(runs, rules.ORDER, rules.PRUNED) for lang, runs in by_lang.items()}
    losses = {r[0]: (r[-2], r[-1]) for r in sent}
    for doc_id, text, lang, *_ in rows[-3:]:
        t = text.translate(fold)
        grams = Counter(t[k : k + rules.ORDER] for k in range(len(t) - rules.ORDER + 1))
        assert losses[doc_id][0] == sum(grams.values())
        assert math.isclose(losses[doc_id][1], -sum(c * math.log(defined[lang](g)) for g, c in grams.items()), rel_tol=1e-5)


def test_verdict_follows_from_losses_and_bands(spark):
    rng = random.Random(7)
    rows = [*ROWS, *((7000 + k, " ".join(words(rng, rng.randint(60, 200))), "en", "a", 1) for k in range(80))]
    rows += [(8000 + k, "".join(rng.choices("!?#/{}[]~^ ", k=900)), "en", "a", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    scored = [r.asDict() for r in rules.scores(docs, rules.fit(docs)).collect()]
    judged = defaultdict(list)
    for r in scored:
        r["failed"] = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        if not r["failed"]:
            judged[r["lang"]].append(r)
    for group in judged.values():
        middle = float(np.median([round(r["loss"] / max(1, r["n_grams"]), 3) for r in group]))
        for r in group:
            r["drawn"] = (r["loss"] + rules.PRIOR_CHARS * middle) / (r["n_grams"] + rules.PRIOR_CHARS)
        mid = float(np.median([r["drawn"] for r in group]))
        reach = rules.REACH * max(float(np.median([abs(r["drawn"] - mid) for r in group])), rules.LEAST * mid)
        for r in group:
            r["kept"] = abs(r["drawn"] - mid) <= reach
    by_id = {(r["doc_id"], r["n_words"], r["kept"]) for r in rules.apply(docs).collect()}
    assert by_id == {(r["doc_id"], r["n_words"], r.get("kept", False)) for r in scored}
    assert len(scored) == len(rows) and not any(k for i, _, k in by_id if i is not None and 8000 <= i < 8003)


def test_perplexity_rejects_noise(spark):
    rng = random.Random(11)
    plain = [(i, " ".join(words(rng, 150)), "en", "a", 1) for i in range(300)]
    noise = (999, "".join(chr(33 + (k * k * 7919 + k * 31) % 90) + (" " if k % 6 == 0 else "") for k in range(2000)), "en", "a", 1)
    got = {r["doc_id"]: r["kept"] for r in rules.apply(spark.createDataFrame([*plain, noise], documents(spark).schema)).collect()}
    assert not got[999]
    assert sum(got[i] for i in range(300)) >= 295


@pytest.mark.parametrize(("percent", "plain"), [(1, 400), (5, 400), (20, 400), (10, 30)])
def test_planted_noise_does_not_move_the_band(spark, percent, plain):
    rng = random.Random(12)
    good = [(i, " ".join(words(rng, rng.randint(150, 300))), "en", "a", 1) for i in range(plain)]
    signs = [chr(c) for c in range(33, 127)] + [" "] * 15
    noise = [(10_000 + i, "".join(rng.choices(signs, k=rng.randint(1500, 4000))), "en", "a", 1) for i in range(max(1, plain * percent // (100 - percent)))]
    got = {r["doc_id"]: r["kept"] for r in rules.apply(spark.createDataFrame([*good, *noise], documents(spark).schema)).collect()}
    assert not any(got[r[0]] for r in noise)
    assert sum(got[r[0]] for r in good) >= 0.98 * plain


def test_copies_do_not_close_the_band(spark):
    rng = random.Random(13)
    copy = " ".join(words(rng, 150))
    rows = [(i, copy if i < 240 else " ".join(words(rng, 150)), "en", "a", 1) for i in range(400)]
    got = rules.apply(spark.createDataFrame(rows, documents(spark).schema)).where("kept").count()
    assert got >= 392


def encodings(name: str) -> list[list[int]]:
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path(name)).encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False)
    return [e.ids for e in made]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    got = packing.pack(documents(spark, extra=True), capacity=256).collect()
    expected = Counter()
    for r, ids in zip(ROWS, encodings("word_bpe_49k.json"), strict=True):
        ids = [*ids, 1]
        for at in range(0, len(ids), 256):
            piece = ids[at : at + 256]
            expected[r[0], at // 256, at, len(piece), crc(piece)] += 1
    assert Counter(tuple(g[:5]) for g in got) == expected
    filled = defaultdict(list)
    for g in got:
        filled[g["sequence_id"]].append((g["offset"], g["length"]))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) <= 1.05 * math.ceil(sum(g["length"] for g in got) / 256) + 1


def test_plan_is_best_fit_decreasing():
    """The plan over counts opens as many sequences as best fit, one piece at a time."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 400).tolist()
    plan = packing.Plan(dict(Counter(sizes)), 100)
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= size]
        room = min(fitting) if fitting else 100
        if fitting:
            rooms.remove(room)
        rooms.append(room - size)
    assert plan.sequences == len(rooms)


def test_token_ids(spark):
    got = collected(idstore.encode_and_read(documents(spark, extra=True)))
    at, expected = 0, []
    pairs = sorted(zip(ROWS, encodings("byte_bpe_50k.json"), strict=True), key=lambda p: (order(p[0][0]), p[0][1] is not None, p[0][1] or ""))
    for r, ids in pairs:
        expected.append((r[0], at, len(ids) + 1, crc([*ids, 2])))
        at += len(ids) + 1
    assert Counter(got) == Counter(expected)


def test_perfect_hash_is_minimal_and_unknown_keys_are_refused():
    keys = idstore.code(np.arange(5000), np.zeros(5000, np.int64))
    built = idstore.PerfectHash.unpack(*idstore.PerfectHash.build(keys).pack())
    assert sorted(built.slots(keys).tolist()) == list(range(5000))


def test_unknown_keys_are_not_found(spark):
    from nearprint.llm.tables import new_folder

    folder = new_folder(spark, "ids")
    idstore.write(documents(spark), folder)
    asked = spark.createDataFrame([(3, 0), (4, 0), (500, 0)], "key bigint, occurrence bigint")
    assert sorted(r["doc_id"] for r in idstore.digest(asked, folder).collect()) == [3, 500]


def test_fingerprints(spark):
    ids = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    expected = Counter()
    for k, r in enumerate(ids):
        text, after = r[1] or "", ids[(k + 1) % len(ids)][1] or ""
        half = len(text) // 2
        expected[r[0], len(text), sha(text[: len(text) - half] + after[:half])] += 1
    got = fingerprints.compare(documents(spark, extra=True)).collect()
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == expected
    assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)
    by_text = defaultdict(set)
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for g in got:
        if g["doc_id"] is not None:
            by_text[texts[g["doc_id"]] or ""].add(g["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    assert all(g["near_edited"] == 1 for g in got if sha(texts.get(g["doc_id"]) or "") == g["edited_sha256"] and g["doc_id"] is not None)


def test_short_texts_have_fingerprints(spark):
    texts = [f"word{k} another" for k in range(40)] + ["", " \n", "same words", "same words"]
    docs = spark.createDataFrame([(k * 1000, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {g["doc_id"] // 1000: g for g in fingerprints.compare(docs).collect()}
    prints = [got[k]["fingerprint"] for k in range(40)]
    assert all(prints) and len(set(prints)) == 40 and got[40]["fingerprint"] == ""
    # 43 follows 0 in descending order, 42 follows 43 and is its equal; 41 and 40 hold no word.
    assert got[43]["near_next"] == got[41]["near_next"] == 1 and got[42]["near_next"] == got[40]["near_next"] == 0


def test_neighbours_of_sparse_ids(spark):
    """Every id in a block of its own, and many null ids."""
    rng = random.Random(9)
    given = [(rng.randrange(2**62), " ".join(words(rng, 8))) for _ in range(120)] + [(None, f"null {k} " * 6) for k in range(40)]
    ids = sorted(given, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    expected = Counter()
    for k, (doc_id, text) in enumerate(ids):
        half = len(text) // 2
        expected[doc_id, sha(text[: len(text) - half] + ids[(k + 1) % len(ids)][1][:half])] += 1
    got = fingerprints.compare(spark.createDataFrame(given, "doc_id bigint, text string")).collect()
    assert Counter((g["doc_id"], g["edited_sha256"]) for g in got) == expected


def test_mixing(spark):
    got = mixing.mix(documents(spark, extra=True)).collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(found_words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:  # clamp and share out anew, until no share is too large
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.remove(s)
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(target[g["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    assert len(got) == len(ROWS)
    for s in names:
        longest = max(g["size"] for g in got if g["source"] == s)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    assert Counter(got) == Counter(mixing.mix(documents(spark).repartition(7)).collect())


def test_empty_tables(spark):
    docs = documents(spark, empty=True)
    for made in (
        mixing.mix(docs), neardup.groups(docs), packing.pack(docs), rules.apply(docs), substrings.digest(docs), lines.dedup(docs),
        fingerprints.compare(docs), idstore.encode_and_read(docs), suffixes.digest(docs),
    ):
        assert made.count() == 0


def test_wide_vocabularies_keep_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "wide.json")
    wide = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_001)}, unk_token="w0"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    wide.save(path)
    docs = spark.createDataFrame([(1, "w1 w65535 w65536 w70000"), (2, "w69999")], "doc_id bigint, text string")
    got = {r[0]: r[2:] for r in collected(idstore.encode_and_read(docs, path=path, end_id=2))}
    assert got == {k: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in ((1, [1, 65535, 65536, 70000, 2]), (2, [69999, 2]))}
    with pytest.raises(ValueError):
        idstore.encode_and_read(docs, path=path, wide=False)


def test_hashes_are_found_in_their_range():
    rng = np.random.default_rng(5)
    h = np.unique(np.concatenate([rng.integers(0, 2**63, 500, dtype=np.uint64), np.arange(7, 40, dtype=np.uint64), np.array([2**64 - 1, 2**64 - 3], np.uint64)]))
    table = rules.Table(h, np.zeros(len(h), np.float32), np.zeros(len(h), np.float32))
    assert len(table.index[0]) <= 4 * len(h) + 2  # ranges in step with the rows, no search over all of them
    wanted = np.concatenate([h, h + np.uint64(1), np.array([0, 2**63], np.uint64)])
    places = {int(x): k for k, x in enumerate(h)}
    assert table.find(wanted).tolist() == [places.get(int(x), -1) for x in wanted]
    assert rules.Table(h[:0], np.zeros(0), np.zeros(0)).find(wanted).tolist() == [-1] * len(wanted)


def test_distinct_hashes_and_a_place_of_each():
    h = np.random.default_rng(6).integers(0, 300, 5000, dtype=np.uint64) << np.uint64(30)
    distinct, some = rules._distinct(h)
    assert distinct.tolist() == np.unique(h).tolist() and (h[some] == distinct).all()
    assert rules._distinct(h[:0])[0].tolist() == []
