"""Every operator against brute force on a small fixture with nulls, empties, long texts, ties, repeats and name clashes."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from vitalframe.llm import bpe, exact_dedup, langid, media, packing, pii, sharding, simhash, substring, token_counts
from vitalframe.llm.common import Tables
from vitalframe.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def by_multiset(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# 1 token counts


def viterbi(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        own = len(word[end - 1].encode())
        options = [(best[end - 1][0] + own * token_counts.BYTE_PENALTY, -(best[end - 1][1] + own))]
        options += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(docs, rows):
    path = tokenizer_path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    seen = {}
    want = Counter()
    for i, t in rows:
        n = 0
        for w in (t or "").split():
            if w not in seen:
                seen[w] = viterbi(token_counts.BLANK + w, scores) if len(w) < 200 else None
            n += seen[w] or 0
        want[i, n if all(seen[w] is not None for w in (t or "").split()) else -1, len((t or "").split())] += 1
    got = Counter()
    for r in token_counts.count_tokens(docs, path).collect():
        got[r["doc_id"], r["n_tokens"], r["n_pretokens"]] += 1
    assert sum(got.values()) == sum(want.values())
    assert all(got[k] == n for k, n in want.items() if k[1] >= 0)


def test_trie_shares_and_resets():
    scores = {"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -5.0, "c": -1.0}
    trie = token_counts.ForwardTrie(scores, most_nodes=8)
    words = ["abc", "abab", "cab", "b", "abcabc", "x", "abc"]
    assert [trie.count(w) for w in words] == [viterbi(w, scores) for w in words]
    assert len(trie.best) <= 8
    assert trie.count("ab" * 100) == viterbi("ab" * 100, scores)


# 2 packing


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, path, 2048, 0).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_packing_over_groups(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(1, 900, 300))], "doc_id long, text string")
    got = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0, group_docs=20).collect()
    assert len(got) == 300 and len({r["doc_id"] for r in got}) == 300
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        assert all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts))) and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1.06 * sum(r["length"] for r in got) / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_local_search(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 60)
    sequence, offset = packing.pack_lengths(sizes, 100)
    for s in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == s)
        order = mine[np.argsort(offset[mine])]
        assert len(order) and (offset[order] == np.concatenate([[0], np.cumsum(sizes[order])[:-1]])).all() and sizes[order].sum() <= 100
    first_fit = []
    for n in sorted(sizes.tolist(), reverse=True):
        for k, held in enumerate(first_fit):
            if held + n <= 100:
                first_fit[k] += n
                break
        else:
            first_fit.append(n)
    assert sequence.max() + 1 <= len(first_fit)


def test_local_search_empties_a_sequence():
    sizes = [55, 30, 50, 30, 20, 15, 5, 95]
    bins, free = [[0, 1], [2, 3, 4], [5, 6], [7]], [15, 0, 80, 5]
    packing._empty_sequences(bins, free, sizes, 100, 8)
    assert sum(1 for b in bins if b) == 3 and sorted(i for b in bins for i in b) == list(range(8))
    assert all(sum(sizes[i] for i in b) + f == 100 for b, f in zip(bins, free))


def test_every_step_raises_the_squared_fill(monkeypatch):
    plain, steps = packing._best_step, []

    def watched(donor, open_, bins, free, sizes):
        step = plain(donor, open_, bins, free, sizes)
        if step is not None:
            other, given, taken = step
            fill = lambda b: sum(sizes[i] for i in bins[b])
            gain = sum(sizes[i] for i in given) - sum(sizes[i] for i in taken)
            steps.append((fill(other) + gain) ** 2 + (fill(donor) - gain) ** 2 - fill(other) ** 2 - fill(donor) ** 2)
        return step

    monkeypatch.setattr(packing, "_best_step", watched)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        packing.pack_lengths(rng.integers(1, rng.integers(300, 1500), 150), 2048)
        packing.pack_lengths(rng.integers(1, 100, 60), 100)
    assert len(steps) > 200 and min(steps) > 0


def test_packing_spreads_repeated_rows(spark):
    """Full pieces meet in no group, and copies of one row go to many groups."""
    docs = spark.createDataFrame([(7, "w " * 100)] * 400 + [(8, "w " * 4096)], "doc_id long, text string").repartition(3)
    got = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 2048, 0, group_docs=20).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == {(7, 101): 400, (8, 2048): 2, (8, 1): 1}
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    groups = Counter(r["sequence_id"] >> 32 for r in got if r["sequence_id"] >= 0)
    assert sum(n == 2048 for n in bins.values()) >= 2 and max(bins.values()) <= 2048
    assert len(groups) > 10 and max(groups.values()) < 60 and len(bins) <= 2 + 24


# 3 SimHash


def brute_print(t):
    w = WORD.findall(lower(t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def roots(prints, reach=2):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(prints)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_simhash(docs, rows):
    prints = {t: brute_print(t) for _, t in rows}
    root, least = roots(set(prints.values())), {}
    for i, t in rows:
        r = root[prints[t]]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t in rows)
    assert by_multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("bucket", [1, 32])
def test_links_connect_all_near_fingerprints(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():  # chains of one to three flipped bits
        for _ in range(12):
            b ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.add(b)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed.values()], "print long"), Tables(spark), 2, bucket)
    found = {(r["node"]): r["root"] for r in simhash.components(links).collect()}
    root = roots(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[root[p]].add(signed[p])
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(v, v) for v in signed.values()}) == len(groups)


def test_golay_indices_meet_within_two_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    other = words.copy()
    for k in range(300):
        for b in rng.choice(23, 2, replace=False):
            other[k] ^= 1 << b
    a, b = golay.indices(words), golay.indices(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    assert {len(set(x)) for x in a.tolist()} <= {1, 6}


def test_bit_sums_of_long_runs():
    h = np.random.default_rng(0).integers(0, 1 << 63, 140_000, dtype=np.uint64)
    got = simhash._bit_sums(h, np.array([0, 5]))
    want = [[int((part >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for part in (h[:5], h[5:])]
    assert got.tolist() == want


# 4 substring


def test_substring(docs, rows):
    size = substring.WINDOW
    split = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    want = Counter()
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert by_multiset(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


# 5 sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(i or 0, 16), jump(i or 0, 17)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)


def test_sharding_negative_and_large_ids(spark):
    ids = [-1, -(1 << 63), (1 << 63) - 1, 0, 12345678901234567]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_documents(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), 7).collect()}
    assert got == {i: (jump(i, 7), jump(i, 8)) for i in ids}


def test_sharding_of_other_ids_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    docs = spark.createDataFrame([("a", "t")] * 10 + [("b", None), (None, "t")], "doc_id string, text string")
    got = sharding.shard_documents(docs, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 12 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == "a"}) == 1


# 6 media


def test_media(docs, rows):
    got = defaultdict(list)
    for r in media.media_documents(docs).collect():
        got[r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]].append((r["media_bytes"], r["media_sha256"], r["feature"]))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert {k: len(v) for k, v in got.items()} == dict(want)
    by_payload = defaultdict(set)
    for k, v in got.items():
        by_payload[k[3]] |= set(v)
    assert all(len(v) == 1 for v in by_payload.values())


def test_media_of_long_texts(spark):
    rows = [(1, "x" * 600_000), (2, "é" * 1_200_000), (3, "x" * 600_000)]
    got = {r["doc_id"]: r for r in media.media_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        b = t.encode()
        p = b + bytes(-len(b) % 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(b), len(p), hashlib.sha256(p).hexdigest())
    assert got[1]["media_sha256"] == got[3]["media_sha256"] and got[1]["feature"] == got[3]["feature"]


def bits_of(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def plain_jpeg(blocks_by_unit, components, width, height, interval):
    """A baseline file written bit by bit, with runs, end-of-block codes, predictions and several components."""
    symbols = sorted({0x00, 0xF0, *range(12), *[r << 4 | s for r in range(16) for s in range(1, 11)]})
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    out = b"\xff\xd8" + media._marker(0xDB, bytes([0] + [2] * 64))
    out += media._marker(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(components)))
    out += media._marker(0xC4, b"\x00" + table) + media._marker(0xC4, b"\x10" + table)
    out += media._marker(0xDD, interval.to_bytes(2, "big")) if interval else b""
    out += media._marker(0xDA, bytes([len(components)]) + b"".join(bytes([i + 1, 0]) for i in range(len(components))) + bytes([0, 63, 0]))
    scan, last, bits = b"", {}, ""

    def flush():
        raw = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""
        return raw.replace(b"\xff", b"\xff\x00")

    for n, unit in enumerate(blocks_by_unit):
        if interval and n and n % interval == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
            bits, last = "", {}
        for c, block in unit:
            size, extra = bits_of(block[0] - last.get(c, 0))
            last[c] = block[0]
            bits += code[size] + extra
            run = 0
            for k in range(1, 64):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += code[0xF0]
                    run -= 16
                size, extra = bits_of(block[k])
                bits += code[run << 4 | size] + extra
                run = 0
            if run:
                bits += code[0]
    return out + scan + flush() + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 2])
def test_decoder_on_general_baseline_files(interval):
    rng = np.random.default_rng(5)

    def block():
        b = np.zeros(64, int)
        b[0] = rng.integers(-200, 200)
        for k in rng.choice(np.arange(1, 64), rng.integers(0, 12), replace=False):
            b[k] = rng.integers(-300, 300)
        return b.tolist()

    grey = [[(0, block())] for _ in range(6)]
    colour = [[(0, block()), (0, block()), (1, block()), (2, block())] for _ in range(4)]
    files = [plain_jpeg(grey, [(1, 1)], 24, 16, interval), plain_jpeg(colour, [(2, 1), (1, 1), (1, 1)], 32, 16, interval)]
    parsed = [media.parse(f) for f in files]
    a, b = media.decode_coefficients(parsed)
    assert a.tolist() == [x for u in grey for _, x in u] and b.tolist() == [x for u in colour for _, x in u]
    assert media.thumbnail(parsed[0], a).shape == (2, 3) and media.thumbnail(parsed[1], b).shape == (2, 4)
    light = media.thumbnail(parsed[0], a)
    assert light[1, 2] == np.clip((grey[5][0][1][0] * 2 + 4) // 8 + 128, 0, 255)


def test_decoder_refuses_other_files():
    for bad in (b"", b"\xff\xd8\xff\xc2\x00\x05abc", b"GIF89a"):
        with pytest.raises(ValueError):
            media.parse(bad)


# 7 language ID


def test_languages(spark):
    import random

    rng = random.Random(0)
    parts = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "ung", "zei", "kt"], "cc": ["éau", "ti", "ço", "nne"]}
    say = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(rng.choices(list(parts), k=240))]
    mixed = [(1000 + k, say("aa", 60 + k) + " " + say("bb", 20), None) for k in range(5)]
    odd = [(2006, "½ ² ① Ⅷ", "aa"), (2000, None, "aa"), (2001, "12 !?", "bb"), (None, "x", None), (2003, "", "cc"), (2004, say("cc", 3000), None), (2005, "q", None)]
    docs = spark.createDataFrame(rows + mixed + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS held_out")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) + len(mixed) + len(odd)
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i]["held_out"] for i, _ in held)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    for i, _, _ in mixed:
        assert got[i]["lang_pred"] == "aa" and 0.5 < got[i]["score"] < 0.95 and "bb" in got[i]["languages"]
    assert [got[i]["lang_pred"] for i in (2000, 2001, 2003, 2004, 2006)] == ["und", "und", "und", "cc", "und"]
    assert got[2000]["score"] == 0.0 and got[None]["held_out"] is False and got[2005]["lang_pred"] in parts


def test_languages_without_labels(spark, docs):
    bare = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(bare).collect()} == {("und", 0.0)}


# 8 exact dedup


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    want = Counter()
    for i, t in rows:
        own = groups[lower(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, sha(lower(t or ""))] += 1
    assert by_multiset(exact_dedup.dedup_documents(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = Counter(sha(lower(r["text"] or "")) for r in exact_dedup.keep_owners(docs).collect())
    assert kept == Counter({sha(k): 1 for k in groups})


@pytest.mark.parametrize("most", [300, 3000, 1 << 30])
def test_trie_spills_by_subtree(most):
    import random

    rng = random.Random(2)
    keys = ["".join(rng.choices("ab", k=rng.randrange(0, 9))).encode() for _ in range(400)] + [b"a" * 500, b"a" * 499 + b"b", b"a" * 500]
    trie, want = exact_dedup.PatriciaOwners(most), {}
    for i, k in enumerate(keys):
        owner = None if i % 7 == 0 else i
        trie.add(k, owner)
        old = want.get(k, (None, 0))
        want[k] = (owner if old[0] is None else old[0] if owner is None else max(old[0], owner), old[1] + 1)
    found = list(trie.items())
    assert len(found) == len(want) and {k: (o, n) for k, o, n in found} == want


@pytest.mark.parametrize("most", [1000, 100_000])
def test_trie_with_long_keys(most):
    long = bytes(range(256)) * 40
    keys = [long, long[:5000], long[:5000] + b"x", long[:5000] + b"xy", b"q" * 9000, b"q" * 9000, long, b"", b"z" * 30_000] + [long[:5000] + bytes([i % 7, i % 5]) * 50 for i in range(300)]
    trie, want = exact_dedup.PatriciaOwners(most), {}
    for i, k in enumerate(keys):
        trie.add(k, i)
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    found = list(trie.items())
    assert len(found) == len(want) and {k: (o, n) for k, o, n in found} == want


def test_texts_beyond_the_trie(spark):
    long = "ab" * 40_000
    rows = [(1, long), (2, long.upper()), (3, long + "c"), (4, long[:-1]), (5, "z"), (6, None), (7, ""), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for limit in (2000, 100_000):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_documents(docs, trie_bytes=limit).collect()}
        assert got == {1: (8, 3, False), 2: (8, 3, False), 8: (8, 3, True), 3: (3, 1, True), 4: (4, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_repeated_texts_stay_in_a_full_trie(spark):
    rows = [(i, "hot text" if i % 2 else f"text {i} " * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        owners = exact_dedup._owners(docs, "doc_id", "text", 20_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["copies"] for r in owners) == 400 and [r["copies"] for r in owners if r["body"] == b"hot text"] == [200]


# 9 personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, t) if fine(kind, m[0]))


PRIVATE = [
    None, "", "mail a.b@c.de, or x@y.z_d@e.fg.", "a@b@c.d", "@a.b a@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.04 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0000 0000 0000",
    "+1 (017) 555-7713 +12 +49.30.123456-7 +123456789012345678", "é😀 a@b.co 😀 10.0.0.1", "ab.c@d.e" * 3, "1" * 30_000, "1 " * 9_000 + "9", "a" * 20_000 + "@b.c", "x@y.z " * 700, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end',
    "ssn 123-45-6789 now", "the general public", "\n+1 234 567 890\n", "5.5.5.5" * 300,
]


def test_personal_data(spark, docs, rows):
    extra = [(5000 + k, t) for k, t in enumerate(PRIVATE)] + [(6000 + k, f'say token = "{hashlib.sha1(bytes([k])).hexdigest()}" ok') for k in range(30)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 AS base", "2 AS more", "'y' AS email")
    want, spans = Counter(), {}
    for i, t in rows + extra:
        b = base_spans(t or "")
        n = Counter(s[3] for s in b)
        text = ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in b)
        spans[i] = (text, t)
        want[i, n["email"], n["ip"], n["card"], n["phone"], sha(text)] += 1
    found = pii.find_personal_data(all_docs).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == want
    for r in found:
        own = [x for x in r["spans"].split(",") if x]
        assert [x for x in own if x.split(":")[0] in KINDS] == [x for x in spans[r["doc_id"]][0].split(",") if x]
        for kind, a, e in (x.split(":") for x in own):
            if kind not in KINDS:
                assert kind in pii.ADDED and int(e) > int(a)
        if r["doc_id"] is not None and r["doc_id"] >= 6000:
            assert [x.split(":")[0] for x in own] == ["secret"]


def test_added_spans_on_labelled_rows(spark):
    """Recall and precision of the spans that the method adds, by kind, on rows with planted and with misleading spans."""
    import random

    rng = random.Random(9)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def iban():
        body = digits(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    true = {
        "secret": lambda: rng.choice(['api token = "{}" set', "password: '{}' (rotated)", "the key {} was revoked"]).replace("{}", hashlib.sha1(digits(9).encode()).hexdigest()),
        "ssn": lambda: rng.choice(["ssn {} on file", "her social security number {} was", "tax identity no {}"]).replace("{}", f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "iban": lambda: rng.choice(["transfer to iban {} today", "pay into account {} please", "bank: {}"]).replace("{}", iban()),
        "local_phone": lambda: rng.choice(["call {} today", "tel {} or mail", "reach me at {} ext"]).replace("{}", f"({rng.randrange(212, 290)}) {rng.randrange(312, 390)}-{digits(4)}"),
        "address": lambda: rng.choice(["lives at {} now", "mail it to {} suite", "our office in {} is"]).replace("{}", f"{rng.randrange(1, 999)} {rng.choice(['Oak', 'Maple Grove', 'Old Mill'])} {rng.choice(['Street', 'Avenue', 'Lane'])}"),
        "name": lambda: rng.choice(["dear {}, we", "signed by {} himself", "the patient {} said"]).replace("{}", f"{rng.choice(['Mary', 'Hans', 'Camille', 'Lucía', 'Dr. Alan'])} {rng.choice(['Weber', 'Johnson', 'Morel', 'Ortega'])}"),
    }
    false = [
        lambda: f"part 000-{digits(2)}-{digits(4)} shipped", lambda: f"serial DE00{digits(18)} in stock", lambda: f"ratio 011-{rng.randrange(100, 199)}-{digits(4)} measured", lambda: "padding " + "a" * 40 + " end", lambda: f"code XX12{'Z' * 16} here",
        lambda: "The General Public License", lambda: "Anna University of software", lambda: f"sum 911 411-{digits(4)} of", lambda: "zeros " + "0" * 32 + " end",
    ]
    fill = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "viso", "nunc"], k=n))
    rows, want = [], {}
    for i in range(900):
        kind = list(true)[i % 6] if i % 3 else None
        middle = true[kind]() if kind else rng.choice(false)()
        want[i] = kind
        rows.append((i, f"{fill(rng.randrange(3, 30))} {middle} {fill(rng.randrange(3, 30))}"))
    found = {r["doc_id"]: [x for x in r["spans"].split(",") if x and x.split(":")[0] in pii.ADDED] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in true:
        planted = [i for i, k in want.items() if k == kind]
        hit = [i for i in planted if any(x.startswith(kind + ":") for x in found[i])]
        assert len(hit) >= 0.9 * len(planted), (kind, len(hit), len(planted))
    wrong = sum(len([x for x in xs if x.split(":")[0] != want[i]]) for i, xs in found.items())
    assert wrong <= 0.1 * sum(map(len, found.values())), wrong


def test_masking(spark):
    docs = spark.createDataFrame([(1, "at a@b.co and 10.0.0.1!", "en"), (2, None, "en"), (3, "clean", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert got == {1: "at [EMAIL] and [IP]!", 2: None, 3: "clean"}


def test_masking_of_odd_rows(spark):
    """Long texts, clashing columns, repeated rows and no rows."""
    long = "word " * 40_000
    rows = [(1, long + "a@b.co " + long), (1, long + "a@b.co " + long), (None, "+49 170 1234567"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "'y' AS base", "'z' AS email", "1 AS _row")
    out = pii.mask_personal_data(docs)
    assert out.columns == docs.columns
    assert Counter(r["text"] for r in out.collect()) == Counter([long + "[EMAIL] " + long] * 2 + ["[PHONE]", ""])
    assert pii.mask_personal_data(docs.limit(0)).count() == 0


# 10 BPE


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert by_multiset(bpe.encode_documents(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_texts():
    import random

    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, own, rng = Tokenizer.from_file(path), bpe.codec(path), random.Random(4)
    some = ["a", "the", "ing", " ", "  ", "\n", "'s", "é", "中", "🙂", "1", "²", "_", "--", "<|endoftext|>", "\x1c", "\xa0", " ", "́", "\r\n", "==", "\t"]
    for _ in range(400):
        t = "".join(rng.choices(some, k=rng.randrange(0, 40)))
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert own.digest(t) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))), repr(t)


# all


def test_empty_tables(empty):
    made = [
        token_counts.count_tokens(empty, tokenizer_path("piece_bpe_32k.model")), packing.pack_documents(empty, tokenizer_path("word_bpe_49k.json")), simhash.near_duplicates(empty),
        substring.remove_repeats(empty), sharding.shard_documents(empty), media.media_documents(empty), langid.identify(empty), exact_dedup.dedup_documents(empty),
        pii.find_personal_data(empty), bpe.encode_documents(empty, tokenizer_path("byte_bpe_50k.json")),
    ]
    assert [df.count() for df in made] == [0] * 10
