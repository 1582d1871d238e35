"""The training-data operators against brute force, round trips and their SQL, and on edge cases."""

import gc
import math
import random
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from codeloom.llm import decontaminate, exact_dedup, hmm, language_id, mixing, quality, simhash, substring_dedup, token_file, warc
from codeloom.llm import queries as llm
from codeloom.llm.common import settle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"
EDGE = [(1, None, "en", "a"), (2, "", None, None), (3, "Hello  World", "en", "a"), (4, "hello  world", "en", "b"), (4, "hello  world", "en", "b"), (None, "hello  world", None, "b"), (6, "123 !!", "de", None), (7, "ß " * 3000, "de", "a")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 1) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï,", "x.y"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    made += made[:6] + [made[7] + " tail", "lead " + made[7], made[8].upper(), " ".join([made[9]] * 2)]
    return list(enumerate(made))


@pytest.fixture(scope="module")
def small(spark, texts):
    return docs_of(spark, [(i, t, "en", f"s{i % 4}") for i, t in texts])


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = llm.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([plain(x) for x in r]) for r in got.select(*names).collect()) == sorted(str([plain(x) for x in r]) for r in cur.fetchall())


def test_cuckoo_index_grows_and_deletes():
    index, keys = exact_dedup.CuckooIndex(2), [xxhash.xxh128_digest(str(k)) * 2 for k in range(3000)]
    for k in keys:
        index.insert(k, [1, 1])
    assert index.resizes and all(map(index.may_contain, keys))
    for k in keys[::2]:
        assert index.delete(k)
    assert not index.delete(keys[0]) and index.get(keys[0]) is None and all(index.get(k) for k in keys[1::2])


def test_index_inserts_and_deletes(spark):
    a, b = (exact_dedup.digests(docs_of(spark, r)) for r in ([(1, "x", None, None), (2, "y", None, None)], [(9, "X", None, None)]))
    index = exact_dedup.add_to_index(exact_dedup.build_index(a), b)
    assert {(r["keep_id"], r["group_size"]) for r in index.collect()} == {(9, 2), (2, 1)}
    assert [r["keep_id"] for r in exact_dedup.remove_from_index(index, b).collect()] == [2]


def test_copies_fold_once_a_partition():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([b"d" * 32, bytes([k]) * 32]), pa.array([k, k], pa.int64())], names=["digest", "keep_id"]) for k in range(3)]
    rows = [r for b in exact_dedup._fold_partition(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 4 and {"digest": b"d" * 32, "keep_id": 2, "group_size": 3} in rows


def test_exact_dedup_edges(edge):
    rows = exact_dedup.assign_groups(edge).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in rows) == [(0, 4, 4), (1, 2, 2), (2, 2, 2), (3, 4, 4), (4, 4, 4), (4, 4, 4), (6, 6, 1), (7, 7, 1)]
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(edge).collect()) == [2, 4, 6, 7]


def components_of(fps):
    root = {k: k for k in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash_links_against_all_pairs(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for k in range(200):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(x, x) for x in signed], "id long, w0 long")
    want = components_of(fps)
    for cap in (1000, 2):
        found = {r["id"]: r["root"] for r in simhash.components(simhash.links(classes, max_bucket=cap)).collect()}
        got = [found.get(x, x) for x in signed]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_simhash_fingerprints(small, texts):
    def brute(t):
        w = t.encode().lower().split()
        s = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))

    got = {r["doc_id"]: r["w0"] % (1 << 64) for r in simhash.fingerprints(small).collect()}
    assert got == {i: brute(t) for i, t in texts}


def test_near_dedup_links_every_pair_at_four_fifths(spark):
    """Short and long texts with one word appended or replaced, at 0.8 and just below."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, linked = [], 0
    for n in [8, 9, 10, 12, 14, 40, 48, 60, 100, 150] * 6:
        text = [word() for _ in range(n)]
        own = [*text, word()]  # n - 4 of n - 3 shingles
        if n >= 40:
            own[n // 2] = word()  # n - 9 of n + 2
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (text, own)]
        linked += 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])
        docs += [(len(docs), " ".join(text)), (len(docs) + 1, " ".join(own))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert 0 < linked < len(docs) // 2
    assert simhash.near_dedup(df).count() == len(docs) - linked


def test_no_pair_of_a_wide_band_is_missed(spark):
    """Near copies whose only common band is one that all classes share."""
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
        texts += [" ".join(words), " ".join([*words, "tail"])]
    hashes = [np.unique(simhash.shingle_hashes(x.encode(), 5, simhash.SEED)) for x in texts]
    signed = lambda x: [int(v) for v in np.array(x, np.uint64).view(np.int64)]
    rows = [(k, k, len(h), k << 40 | k * 0x9E3779B9 & 0xFFFFFFFF, [7], signed(simhash.parity(h)) if hasattr(simhash, "parity") else []) for k, h in enumerate(hashes)]
    classes = spark.createDataFrame(rows, "id long, mark long, n long, w0 long, slots array<long>, odd array<long>")
    found = simhash.similar_links(classes, spark.createDataFrame(list(enumerate(texts)), "mark long, text string"), 5, 80)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(2 * k, 2 * k + 1) for k in range(40)}


def test_parity_never_differs_in_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    for n, own in ((0, 1), (50, 5), (400, 90), (3000, 40)):
        a, b, c = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, own, own))
        apart = int(np.bitwise_count(simhash.parity(np.concatenate([a, b])) ^ simhash.parity(np.concatenate([a, c]))).sum())
        assert apart <= 2 * own and (2 * own - apart) % 2 == 0


def test_shared_and_null_ids_keep_their_own_texts(spark):
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven"), (5, "red green blue white black"), (5, "north south east west up"), (None, "one two three four five six"), (5, "red green blue white black"), (None, "North South East West Up")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, {rows[0], rows[1], rows[2], rows[3]}))
    assert sorted(str(tuple(r)) for r in simhash.near_dedup(df).collect()) == want
    bench = spark.createDataFrame([("i", "seven eight nine ten"), ("j", "north south east west")], "item_id string, text string")
    assert sorted(r["text"] for r in decontaminate.decontaminate(df, bench).collect()) == sorted([rows[0][1], rows[0][1], rows[2][1], rows[2][1]])


def test_near_dedup_keeps_one(edge):
    assert sorted(r["doc_id"] for r in simhash.near_dedup(edge).collect()) == [1, 3, 6, 7]


def test_substring_dedup_against_brute_force(small, texts):
    width = 7
    split = {i: t.split() for i, t in texts}
    seen = Counter(tuple(w[k : k + width]) for w in split.values() for k in range(len(w) - width + 1))
    want = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(small, width).collect()} == want


def test_substring_dedup_edges(edge):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(edge).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 2, 0), (None, 2, 0), (6, 2, 0), (7, 3000, 3000)}
    assert substring_dedup.remove_repeats(edge.limit(0)).count() == 0


def test_decontamination_of_short_items_and_edges(spark, edge):
    bench = spark.createDataFrame([("i1", "World!"), ("i2", "hello world"), ("i2", "hello world"), ("i3", None), (None, "123")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(edge, bench).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (2, 2, 2), 4: (2, 2, 2), None: (2, 2, 2), 6: (1, 1, 0), 7: (3000, 0, 0)}
    assert decontaminate.contamination(edge, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(edge.limit(0), bench).count() == 0


def test_mixing_meets_targets(spark, small, texts):
    rows = mixing.mix_taken(small, block=16).collect()
    again = mixing.mix_taken(small, block=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s = r["doc_id"] % 4
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["size"] == len(texts[r["doc_id"]][1].split())
    assert all(abs(taken[s] - target[s]) <= 3 * 16 for s in target)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    words = Counter()
    for r in mixing.mix_documents(small, block=16).collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_targets_and_plans():
    assert mixing.targets([100, 1, 1], [1, 1, 1]) == pytest.approx([96, 3, 3])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    rng = np.random.default_rng(0)
    for words in (1, 5, 16, 17, 33, 160, 161):
        for want in range(0, 3 * words + 1, max(1, words // 7)):
            p = mixing.SourcePlan(words, want, 16, rng)
            assert p.owed * 16 >= want and p.owed <= 3 * p.blocks
            for slots in {p.owed, max(0, p.owed - 1), min(3 * p.blocks, p.owed + 1)}:
                p.settle(slots)
                sizes = [min(16, words - 16 * k) for k in range(p.blocks)]
                reads = [sizes[(p.step * (j % p.blocks) + p.shifts[j // p.blocks]) % p.blocks] for j in range(slots)]
                if p.cut is not None:
                    assert reads[-1] > p.cut > 0
                    reads[-1] = p.cut
                    assert sum(reads) == want
                elif reads:
                    assert not 0 < sum(reads) - want < reads[-1]
                assert p.passes == (slots - (p.cut is not None)) // p.blocks


def test_mix_against_brute_force(spark, small, texts, monkeypatch):
    placed, _, slots = mixing.plan_mix(small, block=16)
    places, slots = placed.collect(), slots.collect()
    laid = {}
    for r in sorted(places, key=lambda r: r["start"]):
        line = laid.setdefault(r["key"], [])
        assert len(line) == r["start"]
        line += [(r["doc_id"], w) for w in texts[r["doc_id"]][1].split()]
    taken, blocks = Counter(), {}
    for r in slots:
        words = laid[r["key"]][16 * r["block"] : 16 * r["block"] + 16][: r["cut"] if r["cut"] is not None else 16]
        blocks[r["shard"], r["key"][1:], r["slot"]] = [w for _, w in words]
        taken.update(i for i, _ in words)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_taken(small, block=16).collect()}
    assert got == {i: taken[i] for i, _ in texts}
    mixed = {(r["shard"], r["source"], r["slot"]): r["words"] for r in mixing.mixed_blocks(small, block=16).collect()}
    assert mixed == blocks and len({k[0] for k in blocks}) > 3
    # The draws decide which blocks are taken.
    real = mixing.draw_shards
    monkeypatch.setattr(mixing, "draw_shards", lambda plans, rng: real(plans, np.random.default_rng(99)))
    other = {r["doc_id"]: r["taken"] for r in mixing.mix_taken(small, block=16).collect()}
    assert other != got


CLASH = ["_kept_id", "_mark", "_bad_id", "_digest", "mark", "c0", "root", "told", "n_chars", "lang_pred", "score", "words", "out", "text_id"]


def stages():
    return {
        "language": lambda d, b: language_id.keep_identified(d),
        "near": lambda d, b: simhash.near_dedup(d),
        "benchmark": lambda d, b: decontaminate.decontaminate(d, b),
        "mix": lambda d, b: mixing.mix_documents(d),
        "exact": lambda d, b: exact_dedup.exact_dedup(d),
    }


@pytest.mark.parametrize("name", sorted(stages()))
def test_stages_lose_no_row_and_crash_on_no_name(spark, name):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASH)
    long = " ".join(f"word{k % 997} gamma{k % 31}" for k in range(200_000))
    rng = random.Random(4)
    other = lambda: " ".join(rng.choice("alpha beta gamma delta eta theta iota kappa mu nu xi pi rho".split()) for _ in range(60))
    docs = [(None, other()), (None, other()), (4, other()), (4, other()), (5, long), (6, "quote " + other()), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", *range(len(CLASH))) for i, t in docs], schema)
    bench = spark.createDataFrame([("x", docs[5][1])], "item_id string, text string")
    got = stages()[name](df, bench)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    want = {t for _, t in docs if t} - ({docs[5][1]} if name == "benchmark" else set())
    rows = got.collect()
    if name == "mix":  # whole passes and part ones
        assert {i for i, t in docs if t} <= {r["doc_id"] for r in rows} and all(r["_kept_id"] == 0 and r["out"] == CLASH.index("out") for r in rows)
    else:
        assert {r["text"] for r in rows if r["text"]} == want and all(r["score"] == CLASH.index("score") for r in rows)
    assert stages()[name](df.limit(0), bench).count() == 0


def test_mixing_edges(edge):
    assert mixing.mix_taken(edge).count() == len(EDGE)
    assert mixing.mix_taken(edge.limit(0)).count() == 0


def test_token_pieces_encode_alike():
    encoder, rng = token_file.Encoder(token_file.TOKENIZER), random.Random(1)
    plain_tokenizer = Tokenizer.from_file(token_file.TOKENIZER)
    parts = [" ", "  ", "\n", " \n", "\t", "\xa0", "\x85", "\x1c", "'s", "'", "a", "Z", "1", "é", "ß", "!", ".", ",", "日", "😀", "\r\n", "<|endoftext|>", "é", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_file_round_trip(spark, edge):
    rows = sorted(token_file.token_digests(edge, parts=3).collect(), key=lambda r: r["start"])
    plain_tokenizer = Tokenizer.from_file(token_file.TOKENIZER)
    at = 0
    texts = sorted(((i, t or "") for i, t, *_ in EDGE), key=lambda x: (-1 if x[0] is None else x[0]))
    for r, (i, t) in zip(rows, texts, strict=True):
        ids = [*plain_tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.token_digests(edge.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (4, "u", None), (5, "u", ""), (None, "u", "same")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()}
    assert got == {1: ("response", None, "same", 4), 2: ("revisit", 1, "same", 4), 3: ("response", None, "a\r\n\r\nWARC/1.1\r\n\r\nb", 18), 4: ("response", None, "", 0), 5: ("revisit", 4, "", 0), None: ("revisit", 1, "same", 4)}
    assert warc.write_and_read(pages, min_bytes=5).where("record_type = 'revisit'").count() == 0


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = llm.op5_language_id(spark, SF).where("held_out").collect()
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in held)


def test_code_lengths_against_the_recursion():
    text = b"abcabcabxabcab" * 3
    padded = np.frombuffer(b"\0\0\0" + text, np.uint8).astype(np.int64)
    grams, n = np.unique(padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:], return_counts=True)
    model = language_id.Model({"x": (grams, n)})
    seen = Counter()
    whole = b"\0\0\0" + text
    for k in range(3, len(whole)):
        for order in range(4):
            seen[whole[k - order : k], whole[k]] += 1

    def share(context, byte):
        own = {s: c for (x, s), c in seen.items() if x == context}
        if len(context) == 3 and sum(own.values()) < language_id.MIN_CONTEXT:
            own = {}
        shorter = share(context[1:], byte) if context else 1 / 256
        if not own:
            return shorter
        total = sum(own.values()) + len(own)
        return own[byte] / total if byte in own else len(own) / total * shorter

    for probe in (b"abcabx", b"zzz", b"xab q"):
        full = b"\0\0\0" + probe
        want = -sum(math.log2(share(full[k - 3 : k], full[k])) for k in range(3, len(full)))
        assert model.lengths([probe])[0, 0] == pytest.approx(want, rel=1e-5)
    # Escapes exclude nothing, so the lengths meet Kraft's inequality and need not reach 1.
    assert sum(share(b"cab", k) for k in range(256)) <= 1 + 1e-9


def test_language_edges(edge):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge).collect()}
    assert got[1] == got[2] == got[6] == "und"
    assert set(language_id.keep_identified(edge).columns) == set(edge.columns)
    assert language_id.identify(edge.limit(0)).count() == 0


def test_language_stage_rejects_what_no_language_explains(spark):
    rng = random.Random(2)
    words = "the cat sat on a mat and saw that it was good to be there with some of them".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(60)), "en", "a") for k in range(60)]
    dump = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600))
    key = docs[0][1] + " key " + dump[:30]
    got = {r["doc_id"] for r in language_id.keep_identified(docs_of(spark, [*docs, (100, dump, None, "a"), (101, key, "en", "a"), (102, "12 -- 7", "en", "a")])).collect()}
    assert got == {*range(60), 101}


def test_quality(spark, edge):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(edge, none).collect()} == {0.5}


def brute_forward(model, ids):
    a = model.start * model.emit[ids[0]]
    for k in ids[1:]:
        a = (a @ model.move) * model.emit[k]
    return math.log10(a.sum())


def small_model():
    return hmm.Model([b" ", b"a", b"b", b"c"], np.array([5.0, 9, 4, 2]), np.array([[5.0, 4]]), 25, 8)


def test_settling_frees_what_the_lineage_held(spark):
    class Held:
        pass

    held = Held()
    held.itself = held  # as plans and their columns hold each other
    seen = weakref.ref(held)
    gc.disable()
    try:
        del held
        assert settle(spark.range(3), "three").count() == 3 and seen() is None
    finally:
        gc.enable()


def test_language_stage_holds_little_in_a_worker():
    """Neither the encoder of an earlier stage's tasks nor large batches sent on."""
    first = token_file.encoder(token_file.TOKENIZER)
    assert token_file.encoder(token_file.TOKENIZER) is first
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["some words"] * 1000)], names=["c0", "text"])
    out = list(language_id._scored(SimpleNamespace(value=None))(iter([batch])))
    assert [x for b in out for x in b["c0"].to_pylist()] == list(range(1000)) and max(map(len, out)) <= 300
    assert token_file.encoder(token_file.TOKENIZER) is not first


def test_forward_recursion_and_training(monkeypatch):
    rng = np.random.default_rng(1)
    model = small_model()
    texts = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 9, 30)]
    assert hmm.forward(model, texts) == pytest.approx([brute_forward(model, x) for x in texts])
    assert model.emit.sum(0) == pytest.approx(np.ones(hmm.STATES))
    before = hmm.forward(model, texts).sum()
    start, move, emit = hmm.expected(model, texts)
    assert start.sum() == pytest.approx(4) and emit.sum() == pytest.approx(44) and move.sum() == pytest.approx(40)
    # Texts cut into pieces with the messages carried across give the same sums.
    monkeypatch.setattr(hmm, "CELLS", 7)
    for got, want in zip(hmm.expected(model, texts), (start, move, emit), strict=True):
        assert np.allclose(got, want, atol=1e-4)
    for _ in range(10):
        model.update(*hmm.expected(model, texts))
    assert hmm.forward(model, texts).sum() > before


def brute_expected(model, ids):
    """Sums over every sequence of states."""
    start, move, emit, total = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros(model.emit.shape), 0.0
    for z in np.ndindex(*(hmm.STATES,) * len(ids)):
        p = model.start[z[0]] * np.prod([model.emit[i, k] for i, k in zip(ids, z, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(z, z[1:], strict=False)])
        total += p
        start[z[0]] += p
        for a, b in zip(z, z[1:], strict=False):
            move[a, b] += p
        for i, k in zip(ids, z, strict=True):
            emit[i, k] += p
    return start / total, move / total, emit / total


def test_expected_counts_against_all_state_sequences():
    model = small_model()
    ids = np.array([1, 3, 4, 0], np.int32)
    for got, want in zip(hmm.expected(model, [ids]), brute_expected(model, ids), strict=True):
        assert np.allclose(got, want, atol=1e-5)


def test_training_is_distributed_baum_welch(spark):
    docs = spark.createDataFrame([(k, ("a b " if k % 2 else "c d ") * 2000) for k in range(6)], "doc_id long, text string").repartition(4)
    counts = hmm.token_counts(docs)
    trained = hmm.train(docs, counts, rounds=6, warm_rounds=0)
    local, vocabulary = hmm.classes(counts), trained.vocabulary()
    texts = [hmm._ids(vocabulary, r["text"].encode().split()) for r in docs.collect()]
    for _ in range(6):
        local.update(*hmm.expected(local, texts))
    assert np.allclose(trained.emit, local.emit, atol=1e-4) and np.allclose(trained.move, local.move, atol=1e-4)


def test_training_reads_every_document_in_each_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b w{k % 5} " * 3) for k in range(40)], "doc_id long, text string").repartition(3)
    counts, real, read = hmm.token_counts(docs), hmm._sums, []
    monkeypatch.setattr(hmm, "_sums", lambda coded, model: (read.append(sorted(r["row"] for r in coded.select("row").collect())), real(coded, model))[1])
    sums = []
    update = hmm.Model.update
    monkeypatch.setattr(hmm.Model, "update", lambda self, start, move, emit: (sums.append(emit.sum()), update(self, start, move, emit))[1])
    hmm.train(docs, counts)
    everything = sorted(x for part in read[: -hmm.ROUNDS] for x in part)
    assert len(set(everything)) == len(everything) == 40 and all(x == everything for x in read[-hmm.ROUNDS :])
    assert sums[-hmm.ROUNDS - 1 :] == pytest.approx([400.0] * (hmm.ROUNDS + 1), rel=1e-4)


def test_scores_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 9)  # most tokens share rest classes
    counts = hmm.token_counts(small.where("doc_id < 50")).cache()
    model = hmm.train(small, counts, rounds=1, warm_rounds=1)
    n = {r["token"].encode(): r["n"] for r in counts.collect()}
    assert len(model.tokens) == 9 and model.rest.sum() == sum(v + 1 for k, v in n.items() if k not in model.tokens)
    by = {r["doc_id"]: r["score"] for r in hmm.score(small, model, counts, keep=["doc_id"]).collect()}
    vocabulary, some = model.vocabulary(), 0
    for r in small.collect():
        words = [*r["text"].encode().lower().split(), b" "]
        ids = hmm._ids(vocabulary, words[:-1])
        shares = [math.log10((n.get(w, 0) + 1) / (model.rest[i - 9].sum() + 1)) for w, i in zip(words, ids.tolist(), strict=True) if i >= 9]
        some += len(shares)
        assert by[r["doc_id"]] == pytest.approx(brute_forward(model, ids) + sum(shares))
    assert some > 100


def test_language_model_counts(edge):
    rows = hmm.score_documents(edge).collect()
    train = [(t or "").lower().encode().split() + [b" "] for i, t, *_ in EDGE if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(EDGE) and {r["train_tokens"] for r in rows} == {n}
    by = {r["doc_id"]: r for r in rows}
    for i, t, *_ in EDGE:
        w = (t or "").encode().lower().split() + [b" "]
        assert by[i]["n_tokens"] == len(w) and by[i]["n_known"] == sum(c[x] > 0 for x in w)
        assert by[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 100
