"""Corpus operators against plain rules on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidewire.llm import (components, exact_dedup, jaccard_join, mixing, packing, pii, pseudo_likelihood,  # noqa: E402
                          quality, sharding, substring_dedup, training_order)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, `Size` string"


def key(x):
    return (x is not None, x)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(11), []
    vocabulary = [f"w{i}" for i in range(120)]
    for d in range(220):
        r = rng.random()
        if out and r < 0.35:
            words = (rng.choice(out)[1] or "").split()
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(1, 80))
        elif r < 0.45:
            words = ["x", "y"] * rng.randint(1, 90)
        elif r < 0.5:
            words = ["z"] * rng.randint(1, 200)
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 4, 5, 30, 120, 400]))
        out.append((d if rng.random() < 0.95 else rng.choice([3, 7, None]), rng.choice([" ", "  ", "\n"]).join(words)))
    out += [(900, None), (901, ""), (902, " \t\n"), (903, "A b  C"), (904, "A b C"), (904, "A b C"), (None, "A b C"),
            (905, "é " * 9000), (906, "word" * 5000), (None, None)]
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s0", None]), None, "other", "x") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def test_exact_copies(docs, rows):
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    got = exact_dedup.duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for row in got:
        ids = by_hash[row["text_sha256"]]
        assert row["group_size"] == len(ids)
        assert row["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(texts)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)


def test_heavy_texts_are_dealt_out(docs, rows, monkeypatch):
    plain = sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 2)
    assert sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect()), key=str) == plain
    assert exact_dedup.keep_first(docs).count() == len({r[4] for r in plain})


def test_mix(docs, rows):
    got = mixing.mix_sources(docs).collect()
    size, n = Counter(), Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words_of(t))
        n[s] += 1
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(size.values())
    while free:  # share out, cut off, share out again
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2 * size[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for row in got:
        assert row["taken"] <= 2 * row["size"] and row["source_size"] == size[row["source"]]
        assert math.isclose(row["target"], target[row["source"]], rel_tol=1e-9)
        taken[row["source"]] += row["taken"]
    assert len(got) == len(rows)
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 5
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns


NAMES = ["rank", "target", "source_size", "taken", "times", "shard", "Size", "size", "keep_id", "n_words", "kept",
         "component_id", "n_shingles", "round", "held"]


def test_stages_keep_columns_of_any_name(spark, tmp_path, rows):
    import corpus_pipeline

    names = [n for n in NAMES if n != "size"]  # a table cannot have both spellings
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r[:5], *(f"{n} of {r[0]}" for n in names)) for r in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(getattr(r, n) == f"{n} of {r.doc_id}" for r in out.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_rows_without_an_id_are_spread_over_the_ring(spark):
    rows = [(None, f"w{i} x", "hot") for i in range(400)] + [(i, "a b", "small") for i in range(30)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert len({r["shard"] for r in got if r["source"] == "hot"}) > 5 and len(got) == 430 and taken["small"] > 0


def test_mix_meets_small_sources_beside_a_very_large_one(spark):
    sizes = {"hot": [10_000] * 320, "tiny": [1] * 10, "under": [7] * 6, "over": [8] * 10, "mid": [30] * 100}
    assert sum(sizes["tiny"]) * 200_000 < sum(map(sum, sizes.values()))
    table = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, each in sizes.items() for n in each)]
    docs = spark.createDataFrame(table, "doc_id long, source string, n int").selectExpr(
        "doc_id", "source", "repeat('a ', n) AS text").repartition(4)
    taken, target = Counter(), {}
    for r in mixing.mix_sources(docs).join(docs.select("doc_id", "source").withColumnRenamed("source", "s"), "doc_id").collect():
        taken[r["s"]] += r["taken"]
        target[r["s"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(target[s] == 2 * sum(sizes[s]) for s in ("tiny", "under", "over"))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 1
    assert mixing.mix_documents(docs).where("source = 'tiny'").count() >= 19


def test_apportionment_is_that_of_highest_quotients(spark):
    votes = [53.0, 24.0, 23.5, 7.25, 7.25, 1.0]
    targets = spark.createDataFrame(list(enumerate(votes)), "rank long, target double")
    got = {(r["round"], r["rank"]): r["held"] for r in mixing.apportion(targets, 97, 5).collect()}
    for turn in range(1, 6):
        n = 97 * turn // 5
        seats = sorted(((-v / (2 * k - 1), i, k) for i, v in enumerate(votes) for k in range(1, 98)))[:n]
        assert {i: got[turn, i] for i in range(6)} == {i: sum(s[1] == i for s in seats) for i in range(6)}


def test_shards(docs, rows):
    got = sharding.place_documents(docs, shards=5, old_shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(size.values()) - min(size.get(j, 0) for j in range(5)) <= 2 * largest


def test_least_cost_flow():
    rng = random.Random(2)
    for _ in range(30):
        m, n = rng.randint(1, 5), rng.randint(1, 5)
        supply, demand = [rng.randint(0, 30) for _ in range(m)], [0] * n
        for _ in range(sum(supply)):
            demand[rng.randrange(n)] += 1
        flow = sharding.least_cost_flow(supply, demand)
        assert flow.sum(1).tolist() == supply and flow.sum(0).tolist() == demand and (flow >= 0).all()
        stay = sum(flow[i, i] for i in range(min(m, n)))
        assert stay == sum(min(a, b) for a, b in zip(supply, demand))  # the most that can stay


def test_rewrite_touches_changed_blocks_only(spark, docs, tmp_path):
    placed = sharding.place_documents(docs, shards=5, old_shards=4).cache()
    listed = sharding.rewrite_affected(placed, str(tmp_path)).collect()
    assert sum(r["n_rows"] for r in listed) == placed.count()
    written = spark.read.parquet(str(tmp_path))
    assert written.count() == sum(r["n_rows"] for r in listed if r["action"] != "kept")


def test_bin_plan_places_every_piece_once():
    rng = random.Random(4)
    for _ in range(60):
        histogram = {rng.randint(1, rng.choice([60, 400, 2048])): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        bins = defaultdict(list)
        for length, low, high, per_bin, first, offset in packing.plan_bins(histogram):
            for rank in range(low, high):
                bins[first + (rank - low) // per_bin].append((offset + (rank - low) % per_bin * length, length))
        assert Counter(n for b in bins.values() for _, n in b) == Counter(histogram)
        for pieces in bins.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 2048 and sum(3 * n > 2048 for _, n in pieces) <= 2


def test_packing_against_the_tokenizer(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at:first if k == 0 else at + 2048]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(filled) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_the_literal_of_the_added_token_is_its_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewire.llm.tokens import encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "  <|endoftext|>\n\n x ", "<|endoftext|",
             "<|EndOfText|>", "é<|endoftext|>é" * 30, "don't <|endoftext|>'s 12<|endoftext|>34"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [505, 220, 50256, 734] and [encoder()(t) for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs).collect()}
    assert got == {i: zlib.crc32(np.array(ids + [0], "<u4").tobytes()) for i, ids in enumerate(want)}


def test_sequences_hold_the_packed_ids(docs):
    pieces = packing.token_pieces(docs, with_ids=True).cache()
    whole = packing.sequences(packing.pack_pieces(pieces)).collect()
    assert sum(r["n_tokens"] for r in whole) == pieces.groupBy().sum("length").first()[0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 1000])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.feistel(slots, n, back=True) == np.arange(n)).all()


def test_training_order_round_trip(docs, rows, tmp_path):
    table, folder = training_order.materialise_order(docs, str(tmp_path / "shards"), length=64, per_shard=7)
    listed = sorted(table.collect(), key=lambda r: r["slot"])
    n = len(listed)
    assert [r["slot"] for r in listed] == list(range(n))
    assert sorted(r["ordinal"] for r in listed) == list(range(n))
    read = list(training_order.read_sequences(folder, 0, n, n, 64, 7))
    assert [zlib.crc32(s.tobytes()) for s in read] == [r["ids_crc32"] for r in listed]
    assert [s.tolist() for s in training_order.read_sequences(folder, 5, 9, n, 64, 7)] == [s.tolist() for s in read[5:14]]
    stream = np.concatenate([read[r["slot"]][:r["n_tokens"]] for r in sorted(listed, key=lambda r: r["ordinal"])])
    assert np.count_nonzero(stream == training_order.END_OF_TEXT) == len(rows)


def test_quality_features_and_cutoffs(spark, docs, rows):
    def plain(t):
        t = t or ""
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        dup = sum(re.search(r"[^\x20\x09-\x0D]", x) is not None and x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)

    for t in ["", None, "a a a a", "a\n\na\na", " \n \n", "x#| <é>", *[r[1] for r in rows]]:
        assert quality.text_features(t)[:5] == plain(t)
    labels = spark.createDataFrame([(r[0], i % 5 > 0, 0) for i, r in enumerate(rows)], "doc_id long, q boolean, toxic int")
    labels = labels.selectExpr("doc_id", "CAST(q AS INT) AS quality")
    got = quality.quality_verdicts(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_cutoffs_hold_their_risk():
    assert math.isclose(quality.binomial_tail(2, 10, 0.3), sum(math.comb(10, i) * 0.3**i * 0.7**(10 - i) for i in range(3)))
    cutoffs = [1.0, 2.0, 3.0]
    assert quality.walk([500, 0, 0], cutoffs, 2000, 0.01, 0.05) == 2.0
    assert quality.walk([0, 0, 500], cutoffs, 2000, 0.01, 0.05) is None
    assert quality.walk([0, 0, 0], cutoffs, 20, 0.01, 0.05) is None  # too few to prove anything
    rng, wrong = np.random.default_rng(3), 0
    for _ in range(300):  # the true rate of rejection is above the risk at the lowest cutoff
        lost = rng.binomial(1500, 0.012)
        wrong += quality.walk([int(lost), 0, 0], cutoffs, 1500, 0.01, 0.05) == 1.0
    assert wrong <= 0.05 * 300 + 12


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@-+ 2%()_é\n") for _ in range(rng.randint(0, 30)))
        want = sorted((k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text))
        assert sorted(pii.matches(text)) == want


def test_field_adds_what_patterns_lose(spark):
    rng, texts = random.Random(6), []

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    for i in range(400):
        entity = [card(), f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                  f"name.{i}@mail{i % 7}.example.com", f"{i}.5", f"{rng.randint(1900, 2030)},"][i % 6]
        texts.append(f"some words {entity} and more")
    a, b = card(), card()
    texts += [f"paid {a} {b} twice", "in 1999 some 84.2 of 120,000 and v2.0.1", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_spans(docs, pii.fit(docs)).collect()}
    assert found[400]["base_spans"] == "" and found[400]["spans"] == "card:5:21,card:22:38"
    assert found[401]["spans"] == "" and found[402]["spans"] == "" and found[403]["spans"] == ""
    assert all(set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(",")) for r in found.values())
    assert pii.masked(texts[400], found[400]["spans"]) == "paid [card] [card] twice"


def test_training_gradient_is_the_slope_of_the_likelihood():
    field = pii.Field().train([("4 1111111111111111", [("card", 2, 18)], 1.0), ("1999", [], 1.0)] * 3, epochs=40)
    text = "9 1111111111111111"
    assert [k for k, *_ in field.decode(text, [(0, 1), (2, 18)])] in ([], ["card"])
    assert field.decode("1999", [(0, 4)]) == []


def test_near_copies(docs, rows):
    sets = []
    for _, t, *_ in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    got = jaccard_join.similar_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {m for m in least.values()}


def test_one_row_of_each_component_stays(spark, docs, rows):
    def sets_of(t):
        w = [x.lower() for x in words_of(t)]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def want_and_got(table, frame):
        sets, label = [sets_of(r[1]) for r in table], list(range(len(table)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and label[i] != label[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    label = [label[j] if x == label[i] else x for x in label]
        parts = defaultdict(list)
        for i, r in enumerate(table):
            parts[label[i]].append(r)
        kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(frame).collect())
        for i, part in parts.items():
            if not sets[i]:
                assert len(part) == 1
                continue
            least = min(part, key=lambda r: (r[0] is None, r[0] or 0))[0]
            here = {(r[0], r[1]) for r in part}
            assert sum(n for row, n in kept.items() if row in here) == 1  # texts lie in one component only
            assert any(row in here and row[0] == least for row in kept)
        lone = Counter((r[0], r[1]) for i, r in enumerate(table) if not sets[i])
        assert sum(kept.values()) == len([i for i in parts if sets[i]]) + sum(lone.values())
        assert all(kept[row] == n for row, n in lone.items())

    want_and_got(rows, docs)
    rng, table = random.Random(12), []
    for i in range(40):  # unrelated texts: without an id, with one that repeats, with one of their own
        words = [f"t{i}w{k}" for k in range(40)]
        for copy in range(rng.randint(1, 3)):
            table.append((rng.choice([None, None, 5, 6, 100 + i]), " ".join(words[:40 - copy])))
    table += [table[0], table[1], (None, ""), (None, ""), (5, None)]
    want_and_got(table, spark.createDataFrame(table, "doc_id long, text string").repartition(3))


def test_large_blocks_are_dealt_as_pairs_of_parts(docs, monkeypatch):
    plain = sorted(map(str, jaccard_join.similar_documents(docs).collect()))
    monkeypatch.setattr(jaccard_join, "PART", 3)
    assert sorted(map(str, jaccard_join.similar_documents(docs).collect())) == plain


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_repeats(docs, rows):
    first = {}
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i:i + 50])
                first[k] = min(first.get(k, d), d)
    want = Counter()
    for d, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = [True] * 50
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(rest).hexdigest()] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sum(k[2] for k in want.elements()) > 0


def test_every_window_has_a_row_of_anchors():
    hasher = substring_dedup.Hasher()
    for i in range(400):
        for n in (1, 2, 3, 4, 5, 7):
            names = hasher.words([f"p{i}q{k}".encode() for k in range(n)] * (120 // n))
            every = np.unique(substring_dedup.anchor_rows(names, np.zeros(len(names), np.int8))[1])
            assert len(substring_dedup.candidate_windows(names, every)) == len(names) - 49


def test_repeated_phrases_of_four_words(spark):
    rng, texts = random.Random(13), []
    for i in range(100):  # a phrase repeated on and on, and 50 to 70 words of it elsewhere
        phrase, begin = [f"p{i}q{k}" for k in range(4)], rng.randrange(4)
        texts.append([f"a{i}"] * rng.randint(0, 3) + phrase * 30)
        texts.append([f"b{i}b{k}" for k in range(9)] + (phrase * 30)[begin:begin + rng.choice([50, 50, 51, 57, 70])] + [f"c{i}"] * 3)
    first = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    want = set()
    for d, w in enumerate(texts):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = [True] * 50
        want.add((d, sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_scores_equal_the_plain_formula(docs, rows):
    known, flat = pseudo_likelihood.fit(docs)
    net = pseudo_likelihood.Network(flat)
    got = Counter((r["doc_id"], r["n_words"], round(r["log_likelihood"], 1)) for r in
                  pseudo_likelihood.score_documents(docs, known, flat).collect())
    want = Counter()
    for d, t, *_ in rows:
        c = pseudo_likelihood.classes_of(words_of(t), known).tolist()
        padded, total = [pseudo_likelihood.EDGE] * 2 + c + [pseudo_likelihood.EDGE] * 2, 0.0
        for i, x in enumerate(c[:400]):
            around = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
            h = np.tanh(net.bias + sum(net.places[k][a] for k, a in enumerate(around)))
            g, m = divmod(x, pseudo_likelihood.MEMBERS)
            for z, y in ((h @ net.group + net.group_bias, g), (h @ net.member[g] + net.member_bias[g], m)):
                total += z[y] - np.log(np.exp(z).sum())
        if len(c) <= 400:
            want[d, len(c), round(float(total), 1)] += 1
    assert sum((want & got).values()) >= 0.97 * sum(want.values())  # rounding aside


def test_every_word_is_predicted_as_itself(spark):
    rng = random.Random(9)
    common = [f"c{i:04d}" for i in range(pseudo_likelihood.VOCABULARY)]
    rare = [f"r{i:04d}" for i in range(300)]
    texts = [" ".join(common)] * 6 + [" ".join(rng.choices(rare, k=4) + rng.choices(common, k=6)) for _ in range(200)]
    texts += ["c0001 r0007 r0007 c0002", "c0001 r0007 zzzzz c0002", "c0001 r0007 r0007 c0002", None, ""]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    count = Counter(w for t in texts for w in words_of(t))
    known, flat = pseudo_likelihood.fit(docs)
    assert set(known) == {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:pseudo_likelihood.VOCABULARY]}
    totals = Counter()
    for w, n in count.items():
        totals[zlib.crc32(w) % pseudo_likelihood.BUCKETS] += n * (w not in known)
    net, want = pseudo_likelihood.Network(flat), []
    for i, t in enumerate(texts):
        words = words_of(t)
        score = float(pseudo_likelihood.score_words(pseudo_likelihood.classes_of(words, known), net).sum())
        want.append((i if i % 7 else None, len(words), score + sum(math.log(count[w] / totals[zlib.crc32(w) % pseudo_likelihood.BUCKETS]) for w in words if w not in known)))
    got = [(r["doc_id"], r["n_words"], r["log_likelihood"]) for r in pseudo_likelihood.score_documents(docs, known, flat).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4, abs_tol=0.02)


def test_network_learns_what_surrounds_a_word():
    rng = np.random.default_rng(0)
    net = pseudo_likelihood.Network.fresh()
    text = np.tile([5, 40, 77, 300, 12], 4000)
    held_out, shuffled = text[:50], rng.permutation(text[:50])
    before = pseudo_likelihood.score_words(held_out, net).mean()
    window = pseudo_likelihood.windows(text)
    for i in range(0, len(text), 500):
        net.step(window[:, i:i + 500], text[i:i + 500], 0.5)
    after = pseudo_likelihood.score_words(held_out, net).mean()
    assert after > before + 1 and after > pseudo_likelihood.score_words(shuffled, net).mean() + 0.5


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert exact_dedup.duplicate_groups(empty).count() == exact_dedup.keep_first(empty).count() == 0
    assert mixing.mix_sources(empty).count() == mixing.mix_documents(empty).count() == 0
    assert sharding.place_documents(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert training_order.materialise_order(empty)[0].count() == 0
    assert quality.quality_verdicts(empty, labels).count() == quality.keep_good(empty, labels).count() == 0
    assert pii.find_spans(empty, pii.fit(empty)).count() == 0
    assert jaccard_join.similar_documents(empty).count() == jaccard_join.keep_one_of_each(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert pseudo_likelihood.score_documents(empty, *pseudo_likelihood.fit(empty)).count() == 0


def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0]], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    want = {t for r in rows if (t := r[1]) and len(words_of(t)) >= 50}
    assert counts[1] <= sum(r[1] in want for r in rows) and counts[2] <= counts[1] and counts[3] <= counts[2]
    texts = Counter(r["text"] for r in docs.collect())
    assert set(texts) <= want and max(texts.values(), default=0) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert Counter(r["doc_id"] for r in pieces.where("piece = 0").collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_sample_of_islands_counts_copies_once_and_holds_every_kind(spark):
    rng = random.Random(8)
    texts = [f"call +49 30 {rng.randrange(10 ** 6, 10 ** 7)} now" for _ in range(30)]
    texts += ["year 1999 again"] * 3000 + [f"room {i}" for i in range(900)] + ["mail a@b.example today"] * 5 + [None, ""]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = pii.labelled_islands(docs, limit=80).collect()
    islands = [r["island"] for r in rows]
    assert len(islands) == len(set(islands))
    of_kind = Counter(r["spans"][0].split(":")[2] if r["spans"] else "" for r in rows)
    assert of_kind == {"": 40, "phone": 10, "email": 1}
    every = {r["island"] for r in pii.labelled_islands(docs, limit=80_000).collect()
             if not r["spans"]}
    # The first by hash, whatever the number of tasks.
    assert sorted(i for r, i in zip(rows, islands) if not r["spans"]) == sorted(sorted(every, key=pii.sample_hash)[:40])


def test_common_shingles_take_the_most_frequent(spark):
    rows = [(None, k, n) for k, n in [(i, 1000 - i) for i in range(100)] + [(1000 + i, 2) for i in range(5000)]] + [(7, 1, 9)]
    described = spark.createDataFrame(rows, "row_key long, k1 long, n long")
    got = jaccard_join.common_shingles(described, most=600)
    assert set(range(100)) <= set(got.tolist()) and 450 <= len(got) <= 600
    assert len(jaccard_join.common_shingles(described, most=10 ** 6)) == 5100
    assert len(jaccard_join.common_shingles(described.where("n > 5000"))) == 0
