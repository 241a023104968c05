"""Near-dedup, components, decontamination and mixing against brute force, with edge cases."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from storyloom.llm import components, decontaminate, mixing, near_copies, near_dedup

DDL = "doc_id long, text string, lang string, source string, n_chars long, root string, size string, fp string, n string"


def docs(spark, rows):
    """rows: (doc_id, text, source); the extra columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "s", "f", "n") for i, t, s in rows], DDL)


def roots(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while up[x] != x:
            x = up[x]
        out.append(x)
    return out


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAbB É\t\n\x0b\x1f\x85　z", max_size=80))
def test_fingerprint(text):
    assert near_dedup.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = defaultdict(set)
    for node, root in found.items():
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140)), [201, 202]]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_links_join_all_that_is_near(spark):
    r = np.random.default_rng(1)
    centres = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 4))) for c in centres for _ in range(40)]
    fps += [int(x) for x in r.integers(0, 1 << 63, 200, dtype=np.uint64)]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in fps})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3]
    at = {x: i for i, x in enumerate(fps)}
    for tile in (16, 2048):  # small tiles: groups go on over many of them
        links = [(at[x.a], at[x.b]) for x in near_dedup.near_links(table, tile=tile).collect()]
        assert roots(len(fps), links) == roots(len(fps), near)


def test_near_duplicates(spark, sf_dir):
    given_ = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = given_ + [(9001, None, None), (9000, "", "x"), (9002, " \t", "x"), (9003, "Same Words Here", "x"), (9004, "same words\nhere", None), (9004, "same words\nhere", None), (None, "alone in this", "x"), (9005, "long " * 30_000, "x")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    group = roots(len(rows), near)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], fps[i], least[group[i]]) for i in range(len(rows)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert kept.count() == len(set(group))
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.keep_one(docs(spark, [])).count() == 0


def test_near_copies_against_brute_force(spark, sf_dir):
    r = np.random.default_rng(5)
    rows = [(x.doc_id, x.text, x.source) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for c in range(12):  # copies with more and more changed words, around and beyond the limit
        words = [f"w{x}" for x in r.integers(0, 5000, 150)]
        for k in range(10):
            copy = list(words)
            for at in r.choice(150, k, replace=False):
                copy[at] = f"new{k}"
            rows.append((10_000 + 10 * c + k, " ".join(copy), "x"))
    rows += [(9001, None, None), (9000, "", "x"), (9003, "Same Words Here", "x"), (9004, "same words\nhere", None), (9004, "same words\nhere", None), (None, "alone in this", "x"), (9005, "long " * 30_000, "x")]
    sets = []
    for _, text, _ in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    group = roots(len(rows), near)
    first = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    kept = near_copies.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(first.values())
    bits = [plain_fingerprint(rows[i][1]) for i in range(len(rows))]
    assert any(bin(bits[i] ^ bits[j]).count("1") > 3 for i, j in near)  # what 3 bits of three-word shingles miss
    assert near_copies.keep_one(docs(spark, [])).count() == 0


def test_tiled_pairs_against_all(spark):
    """Hot keys that go on over tiles and partitions."""
    r = np.random.default_rng(9)
    base = r.integers(-(1 << 62), 1 << 62, (6, 2))
    rows, node = [], 0
    for key, size in [(1, 300), (2, 2), (3, 1), (4, 40), (9, 700)]:
        for _ in range(size):
            node += 1
            fp = [int(x) ^ sum(1 << int(b) for b in r.integers(0, 62, 6)) for x in base[r.integers(0, 6)]]
            rows.append((key, int(r.integers(80, 120)), node, int(r.integers(0, 5)), *fp))
    d = spark.createDataFrame(rows, "key long, n long, node long, root long, fp0 long, fp1 long")
    want = set()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            bits = sum(bin((x[k] ^ y[k]) & (1 << 64) - 1).count("1") for k in (4, 5))
            if x[0] == y[0] and x[3] != y[3] and bits <= 20 and min(x[1], y[1]) >= 0.8 * max(x[1], y[1]):
                want.add((min(x[2], y[2]), max(x[2], y[2])))
    for tile in (16, 2048):
        found = [(p.a, p.b) for p in near_copies.tiled_pairs(d, 0.8, 20, tile).collect()]
        assert roots(node + 1, found) == roots(node + 1, want)  # not the same pairs, but as connected
        assert tile < 2048 or len(found) < len(want) / 5
    assert len(want) > 1000


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_decontamination(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = next(t for _, t in bench if len(t.split()) > 40)
    words = long.split()
    edited = " ".join([*words[:-1], "changed"])
    given_ = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = given_ + [(9001, "before it " + long.upper().replace(" ", "  ### ") + " after", None), (9002, edited, "x"), (9003, " ".join(words[: len(words) // 2]), "x"), (9004, None, "x"), (9005, "", None), (None, long, "x"), (9006, long + " " + long, "x"), (9007, " ".join(words[4:]), "x")]
    items = bench + [(500, None), (501, ""), (502, "two words")]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, b).collect()}
    want = {}
    index = defaultdict(set)
    for i, t in bench:
        for s in shingles(t):
            index[s].add(i)
    whole = dict(bench)
    for doc, t, _ in rows:
        s = shingles(t)
        for i in {i for x in s for i in index.get(x, ())}:
            item = Counter(shingles(whole[i]))
            n = sum(item.values())
            best = 0
            for k in range(max(1, len(s) - n + 1)):
                w = Counter(s[k : k + n])
                shared = sum((w & item).values())
                best = max(best, shared / (sum(w.values()) + n - shared))
            if best >= 0.8:
                want[doc, i] = round(best, 6)
    assert got == want
    assert {9001, 9002, 9006, None} <= {k[0] for k in got} and not {9003, 9004, 9005} & {k[0] for k in got}
    # the join that shuffles gives the same
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, b).collect()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(rows) - len({k[0] for k in got})
    assert decontaminate.leaks(docs(spark, []), b).count() == 0
    assert decontaminate.leaks(d, b.limit(0)).count() == 0


def test_decontamination_recall_at_the_limit(spark):
    """Windows whose similarity is just 0.8 or more: nearly all lie within the radius of the fingerprints."""
    r = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in r.integers(0, 4000, r.integers(20, 90)))) for i in range(60)]
    rows, want = [], set()
    for k in range(1500):
        i, t = items[k % len(items)]
        words = t.split()
        n = len(words) - 4
        edited = list(words)
        for at in r.choice(len(words), max(1, len(words) // 60), replace=False):
            edited[at] = "changed"
        a, b = Counter(shingles(t)), Counter(shingles(" ".join(edited)))
        shared = sum((a & b).values())
        if 0.8 <= shared / (2 * n - shared) <= 0.86:
            want.add((k, i))
        rows.append((k, "at first " + " ".join(edited) + " at last", "x"))
    assert len(want) > 150
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_decontamination_of_a_long_text_without_broadcast(spark):
    long = " ".join(f"v{i % 7000}" for i in range(20_000))
    item = " ".join(long.split()[500:560])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = decontaminate.leaks(docs(spark, [(1, long, "x"), (2, "short text", "x")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 7, 500, 1.0)]


def mix_targets(sizes, share=1.5, most=2.0, cycle=(3.0, 1.0, 2.0)):
    """The targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if s in full else weight[s] * level
        if not full:
            break
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("kind", ["given", "made"])
def test_mixing(spark, sf_dir, kind):
    if kind == "given":
        rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    else:
        rows = [(i, "w " * (i % 50), "hot") for i in range(3000)] + [(i, "w " * 7, f"s{i % 3}") for i in range(3000, 3300)] + [(5000, None, "empty"), (5001, "a b", None), (5001, "a b", None), (None, "c", "s1")]
    got = mixing.copies(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = mix_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.copies(docs(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mix(docs(spark, rows))
    assert out.columns == [*DDL.replace(" long", "").replace(" string", "").split(", "), "copy_no"]
    assert sum(len((r.text or "").split()) for r in out.collect()) == pytest.approx(sum(taken.values()), abs=2 * max(largest.values()))


def test_mixing_nothing(spark):
    assert mixing.copies(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.copies(docs(spark, [(1, None, None)])).collect()] == [0]


@pytest.mark.parametrize("seed", range(4))
def test_links_between_tiles(seed):
    """Links of two tiles join the groups that all similar sets of them join."""
    r = np.random.default_rng(seed)
    base = [r.integers(0, 1 << 62, 40, dtype=np.uint64) for _ in range(3)]
    rows, sets = [], []
    for node in range(120):
        kept = base[r.integers(0, 3)]
        kept = np.unique(np.concatenate([kept[r.random(40) < r.choice([0.85, 0.95, 1.0])], r.integers(0, 1 << 62, r.integers(0, 4), dtype=np.uint64)]))
        fp = near_copies.sketch(kept)[1].view(np.int64)
        rows.append((len(kept), node, int(r.choice([node, node // 7])), *fp))
        sets.append(kept)
    kind = np.dtype([(f, "<i8") for f in ("n", "node", "root", "fp0", "fp1")])
    rows = np.array(rows, kind)
    joined = np.concatenate
    for x, y in ((slice(0, 120), slice(0, 120)), (slice(0, 70), slice(70, 120))):
        a, b = near_copies.links_between(rows[x], rows[y], joined(sets[x]), joined(sets[y]), x == y, 0.8, 128)
        same = [(i, j) for i in range(120) for j in range(i) if rows["root"][i] == rows["root"][j]]
        want = [(i, j) for i in range(*x.indices(120)) for j in range(*y.indices(120)) if i != j and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert set(zip(a, b, strict=True)) <= set(want) | {(j, i) for i, j in want}
        assert roots(120, same + list(zip(a, b, strict=True))) == roots(120, same + want)
        assert len(a) < len(np.unique(rows["root"]))


def test_a_common_phrase_lays_no_windows(spark):
    """Documents that repeat a phrase which very many items hold; two items are there, one of them made of common shingles only."""
    r = np.random.default_rng(8)
    phrase = "every one of these words"
    filler = [" ".join(f"d{x}" for x in r.integers(0, 10**6, 4)) for _ in range(3000)]
    rows = [(i, " ".join(f"{phrase} {filler[(i * 140 + k) % 3000]}" for k in range(144)), "x") for i in range(20)]
    items = [(i, " ".join(f"i{x}" for x in r.integers(0, 10**6, 5 + i % 40)) + f" {phrase} " + " ".join(f"i{x}" for x in r.integers(0, 10**6, 20))) for i in range(400)]
    rows.append((50, f"so {items[7][1]} and more", "x"))
    items.append((1000, phrase))
    began = time.time()
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, 1000) for i, _, _ in rows} | {(50, 7)}
    assert time.time() - began < 20


def test_numbered_multisets(spark):
    r = np.random.default_rng(2)
    arrays = [[], [5], [7] * 100, list(range(50)) * 2, *(r.integers(0, 6, n).tolist() for n in (3, 17, 64, 200))]
    found = decontaminate.with_multiset(spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, hashes array<bigint>"), "hashes", "out").collect()
    names = {}
    for row in found:
        assert len(set(row.out)) == len(arrays[row.i])
        for h, n in zip(sorted(arrays[row.i]), row.out, strict=True):
            names.setdefault(n, set()).add(h)
    assert all(len(x) == 1 for x in names.values())  # the same element of the multiset has one name everywhere
    assert len(names) == sum(max(Counter(a)[h] for a in arrays) for h in {h for a in arrays for h in a})


def test_names_of_other_columns_dont_matter(spark):
    clashing = ["_hash", "_rows", "_copies", "_text_hash", "_value", "_row", "hash", "text_hash", "rows", "copies", "k_id", "k_hash", "k_rows", "root", "fp", "d", "d_text", "host", "n", "kept", "pos", "a.b"]
    bench = spark.createDataFrame([(1, "the item that must not be in any of the documents here")], "item_id long, text string")
    texts = ["a b c d e f g h", "a b c d e f g h", None, "", "this is the item that must not be in any of the documents here, or is it"]
    rows = [(i, t, "en", f"s{i % 2}", *(f"{c} {i}" for c in clashing)) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", *clashing]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for kept, ids in ((decontaminate.keep_clean(df, bench), {0, 1, 2, 3}), (near_dedup.keep_one(df), {0, 2, 4}), (near_copies.keep_one(df), {0, 2, 4})):
        assert kept.columns == names and {tuple(x) for x in kept.collect()} == {x for x in rows if x[0] in ids}
    mixed = mixing.mix(df)
    assert mixed.columns == [*names, "copy_no"] and {tuple(x)[:-1] for x in mixed.collect()} <= set(rows)


def test_near_copies_of_any_size_are_found(spark):
    """Pairs at the limit, of small sets above all, whose fingerprints lie far apart or which share no band: four words' shingles of five, and other sizes."""
    r = random.Random(9)
    texts = []
    for i in range(1500):
        shingles = 4 if i % 3 else r.choice([8, 12, 16, 20])
        words = [f"w{r.randint(0, 10**9)}" for _ in range(shingles + 4)]
        more = [f"v{r.randint(0, 10**9)}" for _ in range(shingles // 4)]  # n of n + n / 4 shingles are shared: a similarity of 0.8
        texts += [" ".join(words), " ".join(words + more)]
    kept = {x.doc_id for x in near_copies.keep_one(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).select("doc_id").collect()}
    assert kept == set(range(0, len(texts), 2))


def test_prefixes_and_parities_lose_nothing():
    r = np.random.default_rng(10)
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([r.permutation(x)[: len(x) - int(r.integers(0, len(x) // 5 + 1))], r.integers(0, 1 << 63, int(r.integers(0, len(x) // 8 + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        bits = int(np.bitwise_count(near_copies.parities(x) ^ near_copies.parities(y)).sum())
        assert bits <= len(x) + len(y) - 2 * shared
        if shared / (len(x) + len(y) - shared) >= 0.8:
            assert len(np.intersect1d(near_copies.prefix(x, 0.8), near_copies.prefix(y, 0.8)))
            assert bits <= near_copies._most(np.int64(len(x)), np.int64(len(y)), 0.8, None)
