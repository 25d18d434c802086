"""Every operator against brute force on whole small tables, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinforge.llm import bpe, catalog, components, fingerprints, line_dedup, packing, quality, secret_scan, sharding, simhash, suffix_dedup, token_store, tokens

INPUTS = ["docs", "edge_docs"]


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def order(pair):
    return (pair[0] is not None, pair[0] or 0)


@pytest.fixture(params=INPUTS)
def given(request):
    return request.getfixturevalue(request.param)


def test_no_documents(no_docs):
    results = [
        packing.pack(no_docs, catalog.WORD_TOKENIZER), packing.sequences(no_docs, catalog.WORD_TOKENIZER), sharding.byte_shards(no_docs), secret_scan.report(no_docs), secret_scan.masked(no_docs),
        bpe.round_trip(no_docs, catalog.BYTE_RANKS, public_tokenizers.PATTERN), token_store.stored_ids(no_docs, catalog.BYTE_TOKENIZER), line_dedup.line_verdicts(no_docs),
        line_dedup.drop_repeated_lines(no_docs), quality.judged(no_docs), quality.clean(no_docs), simhash.near_duplicates(no_docs), simhash.keep_representatives(no_docs),
        suffix_dedup.repeated_spans(no_docs), fingerprints.with_next(no_docs),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_packing(given):
    library = Tokenizer.from_file(catalog.WORD_TOKENIZER)
    library.encode_special_tokens = True
    want = Counter()
    for doc, text in texts_of(given):
        ids = [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]
        for at in range(0, len(ids), 2048):
            own = np.array(ids[at : at + 2048], "<u4")
            want[doc, at, len(own), zlib.crc32(own.tobytes()), len(ids)] += 1
    rows = packing.pack(given, catalog.WORD_TOKENIZER).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    made = packing.sequences(given, catalog.WORD_TOKENIZER).collect()
    assert sum(r.n_tokens for r in made) == sum(filled.values()) and all(len(r.ids) == 2 * r.n_tokens for r in made)


def test_first_fit_decreasing():
    sizes = np.sort(np.random.default_rng(1).integers(1, 101, 500))[::-1]
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] if at == len(room) else []
        want.append((at, 100 - room[at]))
        room[at] -= s
    assert list(zip(*(x.tolist() for x in packing.first_fit_decreasing(sizes, 100)), strict=True)) == want


def test_sharding(given):
    rows = sharding.byte_shards(given, 4).collect()
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts_of(given))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        by.setdefault(r.shard, []).append(r)
    assert all([r.slot for r in shard] == list(range(len(shard))) for shard in by.values())
    inline = [order((r.doc_id,)) for shard in sorted(by) for r in by[shard]]
    assert inline == sorted(inline)
    target, longest = sum(r["size"] for r in rows) / 4, max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in shard) - target) <= longest for shard in by.values())


def base_spans(text):
    assign = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secret_scan(given):
    want = Counter((d, hashlib.sha256(base_spans(t).encode()).hexdigest()) for d, t in texts_of(given))
    rows = secret_scan.report(given).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert all(r.n_assign + r.n_access + r.n_hex + r.n_added == len(r.spans.split(",")) for r in rows if r.spans)


def test_secret_ownership(spark):
    own, shown = "Ab3" + "dEf4" * 6, "Zz9" + "yXw8" * 6
    rows = [(1, f"key {own} here", "a")] + [(10 + i, f"say {shown} now", f"s{i % 3}") for i in range(6)]
    found = secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.n_added for r in found} == {1: 1} | {10 + i: 0 for i in range(6)}
    masked = secret_scan.masked(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").first()
    assert masked.text == "key [secret] here"


def test_private_keys_of_every_form(spark):
    """Escaped, encrypted, indented and unclosed keys: each has its own value, and none stays in the text."""
    rng, rows = random.Random(3), []
    forms = {
        "plain": ("", "\n", "PRIVATE KEY"), "escaped": ("", "\\n", "PRIVATE KEY"), "twice": ("", "\\\\n", "EC PRIVATE KEY"), "indented": ("", "\r\n\t  ", "PRIVATE KEY"),
        "encrypted": ("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,%s\n\n", "\n", "RSA PRIVATE KEY"),
    }
    for i in range(8):
        for name, (head, end, kind) in forms.items():
            lines = ["".join(rng.choices("ABCDEFGHabcdefgh01234567+/", k=64)) for _ in range(3)] + ["abc" + "".join(rng.choices("abcdefgh", k=6)) + "="]
            body = end + (head % f"{i:032X}" if head else "") + end.join(lines)
            for closed in (True, False):
                tail = f"{end}-----END {kind}-----" if closed else ""
                rows.append((len(rows), f"a - b -----BEGIN {kind}-----{body}{tail}", f"\n({name}) and - prose", f"s{i % 4}"))
    docs = spark.createDataFrame([(i, t + after, s) for i, t, after, s in rows], "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans.split(",") for r in secret_scan.report(docs, max_owners=2).collect()}
    assert [i for i, t, _, _ in rows if f"private:6:{len(t)}" not in spans[i] and f"private:6:{len(t) + 1}" not in spans[i]] == []
    masked = {r.doc_id: r.text for r in secret_scan.masked(docs, max_owners=2).collect()}
    assert all(re.fullmatch(r"a - b \[secret\]\n?\(\w+\) and - prose", t) for t in masked.values())


def test_private_key_heads(spark):
    """A head line that is only spoken of takes no prose along, a second key is a span of its own, long texts end."""
    head, tail = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    texts = [f"{head} is the head of a key", f"{head}\nAAAA\n{head}\nBBBB\n{tail} end", head + "-a b" * 100_000, head + "- " * 100_000 + tail]
    found = secret_scan.report(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("private")] for r in found}
    assert got == {0: ["private:0:27"], 1: ["private:0:33", "private:33:91"], 2: ["private:0:27"], 3: [f"private:0:{len(texts[3])}"]}


def test_copies_do_not_make_an_example(spark):
    """Live: copies of one text, a document copied under one more source, many texts of one owner. Example: texts of two owners."""
    value = lambda i: f"Ab{i}" + "dEf4" * 6
    rows = [(i, f"copy {value(1)} here", "a") for i in range(6)] + [(10, f"moved {value(2)} here", "a"), (11, f"moved {value(2)} here", "b")]
    rows += [(20 + i, f"text {i} {value(3)} here", "a") for i in range(9)] + [(30 + i, f"text {i} {value(4)} here", f"s{i}") for i in range(2)]
    found = secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.n_added for r in found} == {i: int(i < 30) for i, _, _ in rows}


def test_bpe(given):
    encoder = bpe.loaded(catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    want = Counter()
    for doc, text in texts_of(given):
        ids = library.encode_ordinary(text)
        want[doc, len(ids), hashlib.sha256(tokens.packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(given, catalog.BYTE_RANKS, public_tokenizers.PATTERN).collect())) == want


PARTS = [" ", "  ", "\n", "\t", "a", "B", "'", "s", "'ll", "é", "é", "́", "22", "...", ",", "\x1c", "\x85", "\xa0", "　", "ß", "İ", "中", "😀", "<|endoftext|>", "aaaa", "\r\n", "\x00", "Σ"]


def test_chunked_ids_are_the_libraries():
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25))) for _ in range(2000)]
    encoder = bpe.loaded(catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    assert all(encoder.encode(t) == tokens.packed(ranked.encode_ordinary(t)) for t in odd)
    for path in (catalog.WORD_TOKENIZER, catalog.BYTE_TOKENIZER):
        library, own = Tokenizer.from_file(path), tokens.text_ids(path)
        library.encode_special_tokens = True
        want = [tokens.packed(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
        assert [own(t) for t in odd] == want
        ids, bounds = tokens.column_ids(pa.array(odd).slice(3), tokens.chunk_ids(path))
        assert [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])] == want[3:]


def test_edits_keep_the_encoding():
    rnd, encoder = random.Random(6), bpe.loaded(catalog.BYTE_RANKS, public_tokenizers.PATTERN)
    for _ in range(500):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(20)))
        held = bpe.EditableText(encoder, text)
        for _ in range(3):
            start = rnd.randrange(len(text) + 1)
            end, new = rnd.randrange(start, len(text) + 1), "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(3)))
            text = text[:start] + new + text[end:]
            held.replace(start, end, new)
            assert held.text == text and held.ids() == encoder.encode(text)
    table = bpe.PrefixTable(encoder.vocabulary, b"hel")
    table.append(b"loworld")
    table.replace(3, 5, b"pful")
    assert table.ids() == bpe.PrefixTable(encoder.vocabulary, b"helpfulworld").ids()


def test_token_store(given):
    library = Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    library.encode_special_tokens = True
    want, start = Counter(), 0
    rows = token_store.stored_ids(given, catalog.BYTE_TOKENIZER).collect()
    for doc, text in texts_of(given):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    inline = [order((r.doc_id,)) for r in sorted(rows, key=lambda r: r.start)]
    assert inline == sorted(inline)


def test_perfect_hash():
    keys, numbers = np.arange(-5000, 5000), np.zeros(10_000, np.int64)
    function = token_store.PerfectHash.build(keys, numbers)
    assert sorted(function.find(keys, numbers)) == list(range(10_000)) and len(function) == 10_000


def test_keys_not_in_the_store(spark, docs):
    uri = token_store.new_store(spark)
    token_store.write_store(docs, catalog.BYTE_TOKENIZER, uri)
    asked = spark.createDataFrame([(0, 0), (0, 1), (10**9, 0)], "key long, number long")
    assert [(r.key, r.number) for r in token_store.read_store(asked, uri).collect()] == [(0, 0)]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_line_dedup(spark, given):
    verdicts = line_dedup.line_verdicts(given).collect()
    lines, want = [], {}
    ordered = sorted({(r.doc_id, r.text_hash) for r in verdicts}, key=lambda k: (order(k), k[1]))
    by_key = {(r.doc_id, r.h): r.t for r in given.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    for key in ordered:
        want[key] = []
        for no, line in enumerate(by_key[key].split("\n")):
            words = line.encode().translate(line_dedup.LOWER).split()
            if len(words) >= line_dedup.MIN_WORDS:
                if any(one_edit(words, w) for w in lines if abs(len(w) - len(words)) < 2):
                    want[key].append(no)
                lines.append(words)
    assert {(r.doc_id, r.text_hash): r.removed for r in verdicts} == want
    kept = line_dedup.drop_repeated_lines(given)
    assert kept.columns == given.columns
    assert all(r.n_chars == len(r.text) for r in kept.where("text is not null").collect())


def test_line_dedup_of_short_lines(spark):
    """Equal lines of any length go but for the first; one edit counts from five words on."""
    docs = [(0, "Home\nsign in now\na b c d e\na b c d e f g\n\nown"), (1, "home\nsign  in now\nsign in here\na b x d e\na b c d e f g h\n\nHome"), (2, "own\nsign in now")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = line_dedup.line_verdicts(frame, line_dedup.EVERY_LINE, line_dedup.NEAR_WORDS).collect()
    assert {r.doc_id: (r.n_long, r.removed) for r in found} == {0: (5, []), 1: (6, [0, 1, 3, 4, 6]), 2: (2, [0, 1])}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame).collect()} == {0: docs[0][1], 1: "sign in here\n"}


def test_quality_base_rules(given):
    rows = quality.judged(given).collect()
    want = Counter()
    for doc, text in texts_of(given):
        words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
        want[doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(raw) - len(set(raw)), len(covered)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want


def test_quality_frequent_lines(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    notice = "please accept all cookies " + " ".join(f"notice{j}" for j in range(60))
    rows = [(i, f"{notice}\n{own(i, 55 if i % 2 else 200)}", "host") for i in range(20)] + [(100 + i, own(i + 50, 80), "host") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == {i for i, _, _ in rows if i >= 100 or i % 2 == 0}
    texts = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert notice in texts[0] and all(notice not in t for i, t in texts.items() if i)


def test_quality_lines_of_a_large_host(spark):
    """Ten documents make a line boilerplate on a host of thousands; nine do not."""
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    ten, nine = (" ".join(f"{name}{j}" for j in range(80)) for name in ("notice", "banner"))
    rows = [(i, own(i, 60) + (f"\n{ten}" if i < 10 else f"\n{nine}" if i < 19 else ""), "host") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality.judged(docs)
    assert {r.doc_id: r.removed_words for r in found.where("removed_words > 0").collect()} == dict.fromkeys(range(1, 10), 80)
    assert {r.doc_id for r in found.where("not kept").collect()} == set(range(1, 10))
    assert quality.judged(docs, min_share=quality.MIN_SHARE).where("removed_words > 0").count() == 0


def test_simhash(given):
    rows = simhash.near_duplicates(given).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in rows) == Counter((d, simhash.fingerprint(t)) for d, t in texts_of(given))
    fps = sorted({r.fp % 2**64 for r in rows})
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for r in rows:
        if r.doc_id is not None:
            key = root[r.fp % 2**64]
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in rows)


def test_simhash_tiles_and_clusters(spark):
    rnd = random.Random(9)
    bases = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(4))) for b in bases for _ in range(40)}
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = {(r.node % 2**64, r.root % 2**64) for r in components.components(simhash.links(nodes, 3, tile_rows=64)).collect()}
    groups = {}
    for n, r in got:
        groups.setdefault(r, set()).add(n)
    left, want = set(fps), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= 3}
            left -= near
            todo += near
        want.append(group)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want if len(g) > 1)


@pytest.mark.parametrize("size", [4, 50, 200])
def test_repeated_bytes(given, size):
    data = [(d, t.encode()) for d, t in texts_of(given)]
    seen = Counter(x[i : i + size] for _, x in data for i in range(len(x) - size + 1))
    want = Counter()
    for doc, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[doc, len(x), int(gone.sum()), runs, bytes(np.frombuffer(x, np.uint8)[~gone])] += 1
    rows = suffix_dedup.without_spans(suffix_dedup.repeated_spans(given, size)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == want


def test_a_passage_of_most_documents_is_settled_in_its_slices(spark):
    """Every document holds one passage, in the same or other surroundings; few rows of it meet in one task."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    shared = [f"{k}" * 9 + passage + f"{k}" * 9 for k in range(5)]
    made = [(i, rnd.choice([rnd.choice(shared), f"{i:030d}" + passage + f"{i:030d}", "xy" * 80])) for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    seen = Counter(t[i : i + 40] for _, t in made for i in range(len(t) - 39))
    want = []
    for d, t in made:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 39):
            gone[i : i + 40] |= seen[t[i : i + 40]] > 1
        want.append((d, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    got = suffix_dedup.without_spans(suffix_dedup.repeated_spans(docs, 40))
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got.collect()) == want
    dealt = docs.selectExpr("doc_id AS doc", "xxhash64(text) AS h", "text").mapInArrow(suffix_dedup._anchor_rows(40), suffix_dedup._ANCHOR_DDL)
    assert dealt.count() > 5_000
    assert max(r["count"] for r in dealt.groupBy("deal").count().collect()) <= 2 * 6


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def test_fingerprints(given):
    """Rows, edits, shapes and likeness by what they are to be; sketches only by the number of their hashes."""
    keyed = [((r.doc_id is not None, r.doc_id or 0, r.h), r.doc_id, r.t) for r in given.selectExpr("doc_id", "coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()]
    keyed.sort(key=lambda x: x[0])
    want = Counter()
    for i, (_, doc, text) in enumerate(keyed):
        after = keyed[(i + 1) % len(keyed)][2]
        n = len(text) // 4
        want[doc, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest(), len(shingles_of(text)), text == after] += 1
    rows = fingerprints.with_next(given).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, int(r.fingerprint.split(":")[0]), r.near_next == 1) for r in rows) == want
    by_id, texts = {}, {}
    for _, doc, text in keyed:
        texts.setdefault(doc, set()).add(text)
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.fingerprint)
        a, b = ({x[i : i + 16] for i in range(0, len(x), 16)} for x in (r.fingerprint.split(":")[2], r.edited_fingerprint.split(":")[2]))
        same = r.fingerprint.split(":")[1] == r.edited_fingerprint.split(":")[1]
        union = len(a | b) + (a == b)
        assert r.near_edited == (1 if same else len(a & b) / union) and r.edited_has == (len(a & b) / len(a) if a else None)
    assert {d: len(f) for d, f in by_id.items()} == {d: len(t) for d, t in texts.items()}


def test_likeness_is_near_the_true_one(spark):
    """Estimates against exact shingle sets: edited texts, a short part of a long text, unrelated short texts."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    long = word(4000)
    pairs = []
    for edits in (0, 20, 200, 2000):
        new = list(long)
        for at in rng.choice(4000, edits, replace=False):
            new[at] = "x"
        pairs.append((long, new))
    part = long[1000:1400]
    pairs += [(part, long), (part, part + word(8000)), (word(3000), word(3000))]
    for a, b in pairs:
        x, y = shingles_of(" ".join(a)), shingles_of(" ".join(b))
        near, has = fingerprints.overlap(fingerprints.sketch(" ".join(a)), fingerprints.sketch(" ".join(b)))
        assert abs(near - len(x & y) / len(x | y)) < 0.06 and abs(has - len(x & y) / len(x)) < 0.12
    for n in range(1, 13):
        for _ in range(100):
            assert fingerprints.overlap(fingerprints.sketch(" ".join(word(n))), fingerprints.sketch(" ".join(word(n))))[0] < 0.1
    kept = [len(fingerprints.sketch(" ".join(word(10)))[2]) for _ in range(300)]
    assert 1.5 < sum(kept) / 300 < 2.5
    frame = spark.createDataFrame([(1, " ".join(part)), (2, " ".join(long)), (3, " ".join(part + long))], "doc_id long, text string")
    one = fingerprints.sketches(frame).collect()
    row = spark.createDataFrame([(one[0].hashes, one[1].hashes, one[2].hashes)], "a array<long>, b array<long>, both array<long>").select(fingerprints.containment("a", "b").alias("c"), fingerprints.containment("b", "a").alias("d"), F.size(F.array_except("both", fingerprints.merged("a", "b"))).alias("more")).first()
    assert row.c == 1 and 0.03 < row.d < 0.2 and row.more <= 3


def test_fingerprint_buckets(spark):
    """More ranges than one stride, rows that are bounds, and repeated ones."""
    rng = random.Random(1)
    bounds = sorted({(rng.randrange(-50, 50), rng.randrange(-5, 5)) for _ in range(150)})
    asked = [(k, h) for k in range(-52, 52) for h in range(-6, 6)]
    rows = spark.createDataFrame(asked, "key long, h long").select("key", "h", fingerprints._places(bounds).alias("p")).collect()
    for r in rows:
        at = max(0, sum(b <= (r.key, r.h) for b in bounds) - 1)
        want = [(at, False)] + ([((at - 1) % len(bounds), True)] if bounds[at] == (r.key, r.h) else [])
        assert [tuple(x) for x in r.p] == want


def test_pipeline(spark, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == edge_docs.columns
            docs = corpus_pipeline.stored(out, name)
    assert sum(r.n_tokens for r in out.collect()) > 0


def test_keep_representatives_finds_edited_copies(spark, tmp_path):
    """Copies alike by 0.8 or more of five-word shingles go, texts alike by less stay."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 100_000, n)]
    rows, n = [], 0
    for g in range(60):
        base = word(300)
        rows.append((n, " ".join(base)))
        for edits in (1, 3, 5, 60):
            near = list(base)
            for at in rng.choice(300, edits, replace=False):
                near[at] = f"new{rng.integers(0, 10**9)}"
            n += 1
            rows.append((n, " ".join(near)))
        n += 1
    rows += [(None, None), (10**6, ""), (10**6 + 1, " \n")]

    def alike(a, b):
        x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
        return len(x & y) >= 0.8 * len(x | y)

    want, kept = set(), []
    for d, t in rows[:-3]:
        if not any(alike(t, k) for k in kept[-8:]):
            kept.append(t)
            want.add(d)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("mine")).write.parquet(path)
    got = {r.doc_id for r in simhash.keep_representatives(spark.read.parquet(path)).collect()}
    assert got == want | {10**6}


def test_keep_representatives_under_two_parallelisms(spark, docs, tmp_path):
    """The same rows stay however the input is packed into partitions while it is read."""
    path, kept = str(tmp_path / "docs"), []
    near = docs.select(F.col("doc_id") + 10**6, F.concat("text", F.lit(" and one word more"))).toDF("doc_id", "text")
    docs.select("doc_id", "text").union(near).repartition(7, "doc_id").write.parquet(path)
    for size in ("64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            result = simhash.keep_representatives(spark.read.parquet(path))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        kept.append(sorted(r.doc_id for r in result.collect()))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kept[0] == kept[1] and len(kept[0]) <= docs.count() + 40


@pytest.mark.parametrize("tile", [600, 1 << 19])
def test_open_links_leave_no_pair_out(spark, tmp_path, tile):
    """Groups in which many texts lie just below or above the similarity: components as by brute force."""
    rng = np.random.default_rng(11)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(200)]
        for k in range(60):
            near = list(base)
            for at in rng.choice(200, rng.integers(1, 9), replace=False):
                near[at] = f"new{k}x{rng.integers(0, 10**9)}"
            texts.append(" ".join(near))
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "row long, text string").write.parquet(path)
    rows = spark.read.parquet(path)
    marked = simhash._marked(rows.withColumn("doc_id", F.col("row")), "row", 5)
    alone = marked.select("fp", F.col("fp").alias("root")).distinct()
    links = simhash.open_links(marked, alone, rows, 5, 0.8, tile).collect()

    parts = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    signed = lambda f: f - 2**64 if f >> 63 else f
    fps = [signed(simhash.fingerprint(t, 5)) for t in texts]
    alike = {(fps[i], fps[j]) for i in range(len(texts)) for j in range(i) if len(parts[i] & parts[j]) >= 0.8 * len(parts[i] | parts[j])}

    def classes(pairs):
        top = {f: f for f in fps}

        def find(f):
            while top[f] != f:
                f = top[f]
            return f

        for u, v in pairs:
            top[find(u)] = find(v)
        groups = {}
        for f in set(fps):
            groups.setdefault(find(f), set()).add(f)
        return set(map(frozenset, groups.values()))

    want = classes(alike)
    assert len(want) > 4 and max(map(len, want)) > 10
    assert classes((r.u, r.v) for r in links) == want
