"""Filter audit, conversation repair and segment-tree BPE against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinforge.llm import catalog, chunks, conversations, filter_audit, segment_bpe

CONVERSATION = "conv_id long, turn long, role string, text string, audit int, same string"


def audit_rows(docs, labels):
    """What every order removes, document by document."""
    first = {}
    for d, _, t in docs:
        first[t] = min(first.get(t, (True, 1 << 62)), (d is not None, d or 0))
    out = {}
    for d, part, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": (d is not None, d or 0) > first[t],
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                row[0] += not gone and not fails[x]
                row[1] += not gone and fails[x]
                row[2] += gone and fails[x]
                row[3] += fails[x] and sum(fails.values()) == 1
                if not gone and fails[x]:
                    row[4] += any(q == 1 for i, q, _ in labels if i == d and d is not None)
                    row[5] += any(q == 1 for i, _, q in labels if i == d and d is not None)
                gone |= fails[x]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_removal_intervals_are_the_orders():
    for n in (1, 3, 5):
        orders = list(itertools.permutations(range(n)))
        found = Counter((mask, rank, step) for mask, step, lo, hi in filter_audit.removal_intervals(n) for rank in range(lo, hi))
        assert found == Counter((m, r, next(i for i, x in enumerate(o, 1) if m >> x & 1)) for m in range(1, 1 << n) for r, o in enumerate(orders))


def test_filter_audit(spark, edge_docs):
    labels = [(0, 1, 0), (1, 1, 1), (5, 0, 1), (5, 1, None), (7, 1, 0), (None, 1, 1), (99, 1, 1)]
    rare = spark.createDataFrame([(20 + i, f"w{i} " * 3 + "Ab|", "c") for i in range(4)], "doc_id long, text string, source string")
    docs = edge_docs.select("doc_id", "text", "source", "h", "lines").unionByName(rare, allowMissingColumns=True)
    got = [tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    want = audit_rows([(r.doc_id, r.source or "", r.text or "") for r in docs.collect()], labels)
    assert len(got) == len(want) and set(got) == want


def test_filter_audit_of_nothing(spark, no_docs):
    assert filter_audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def every_way(rows):
    """(cost, audit) by trying all edits, with one or two rows put in anywhere."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in (1, 2) for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        if any(e == "K" and i not in "sua" for e, (i, _) in zip(edits, rows, strict=True)):
            continue
        base = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and f == 3 else 0) for e, (_, f) in zip(edits, rows, strict=True))
        if best is not None and base > best[0]:
            continue
        for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(3)):
            cost, audit, kinds = base + 5 * len(places), "", []
            for at in range(len(rows) + 1):
                audit += "I" * places.count(at)
                kinds += ["ua"] * places.count(at)
                if at < len(rows):
                    audit += edits[at]
                    kinds += [] if edits[at] == "D" else [rows[at][0]] if edits[at] == "K" else ["ua"]
            rest = kinds[1:] if kinds and kinds[0] == "s" else kinds
            legal = len(rest) % 2 == 0 and all("ua"[i % 2] in k for i, k in enumerate(rest)) and (bool(rest) or not kinds)
            if legal and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_edits():
    rnd = random.Random(4)
    for _ in range(400):
        rows = [(rnd.choice("suuaax"), rnd.choice((0, 0, 0, 1, 2, 3))) for _ in range(rnd.randrange(6))]
        assert conversations.cheapest(rows) == every_way(rows), rows


def plain_search(rows):
    """(cost, audit) with whole strings for every state and nothing dropped."""
    ways = {0: (0, "")}
    after = lambda s: 3 if s == 2 else 2
    for initial, fault in rows:
        found = {}
        for state, (cost, text) in ways.items():
            for _ in range(3):
                options = [(state, cost + 2, text + "D")]
                if fault not in (1, 2):
                    extra = 5 if fault == 3 else 0
                    options.append((after(state), cost + 1 + extra, text + "R"))
                    if initial == "s" and state == 0:
                        options.append((1, cost + extra, text + "K"))
                    if initial == "ua"[state == 2]:
                        options.append((after(state), cost + extra, text + "K"))
                for to, *way in options:
                    found[to] = min(found.get(to, tuple(way)), tuple(way))
                state, cost, text = after(state), cost + 5, text + "I"
        ways = found
    return min((c + 5 * len(more), t + more) for s, (c, t) in ways.items() for more in [("", "II", "I", "")[s]])


@pytest.mark.parametrize("kind", ["mixed", "users", "blank", "truncated", "alternating"])
def test_long_conversations(kind):
    rnd = random.Random(8)
    rows = {
        "mixed": [(rnd.choice("suuaax"), rnd.choice((0, 0, 0, 1, 2, 3))) for _ in range(700)], "users": [("u", 0)] * 301, "blank": [("u", 0)] + [("a", 1)] * 300 + [("s", 0)],
        "truncated": [(rnd.choice("ua"), 3) for _ in range(400)], "alternating": [("ua"[i % 2], 0) for i in range(401)],
    }[kind]
    assert conversations.cheapest(rows) == plain_search(rows)


def test_survivors_are_bounded():
    """The past of a long conversation is given out while it streams."""
    rnd, survivors, given = random.Random(2), conversations.Survivors(), 0
    for i in range(20_000):
        given += sum(e in b"KRD" for e in survivors.row("ua"[i % 2] if rnd.random() < 0.9 else rnd.choice("sua"), rnd.choice((0,) * 9 + (1, 2, 3))))
        assert i + 1 - given < 300


def conversation_rows(rows):
    """The report by plain code over the rows of a table."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    out = set()
    for conv, own in by.items():
        same = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, same(r)))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = plain_search([(r[:1], f) for (_, r, _), f in zip(own, faults, strict=True)])
        kept, left, roles = [], iter(own), 0
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit == "K":
                kept.append(f"{role}:{text}")
                roles += not role.startswith("s")
            else:
                kept.append(f"{'assistant' if roles % 2 else 'user'}:{text}")
                roles += 1
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, faults.count(1), faults.count(2), faults.count(3), pairs, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def odd_conversations(spark):
    rnd, rows = random.Random(12), []
    for conv in [None, *range(300)]:
        for turn in sorted(rnd.sample(range(14), rnd.randrange(1, 9))):
            text = rnd.choice(["Hi there.", "Yes!", "no end", "", " \t", None, "éè?", f"own {conv} {turn}.", "x" * 3000 + "."])
            rows.append((conv, turn if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
        if rnd.random() < 0.2:
            rows.append(rows[-1])
    rows += [(1000, t, "ua"[t % 2], f"turn {t % 7}.") for t in range(3000)] + [(1001, None, None, None)] * 3 + [(1002, 5, "user", "Same.")] * 40
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_conversation_report(spark, sf_dir, which):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet") if which == "table" else odd_conversations(spark)
    got = [tuple(r) for r in conversations.report(given).collect()]
    want = conversation_rows([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want) and set(got) == want


def test_repaired_rows_are_what_is_hashed(spark):
    given = odd_conversations(spark)
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.report(given).collect()}
    rows = {}
    for r in conversations.repaired(conversations.damaged(given)).orderBy("conv_id", "position").collect():
        assert r.position == len(rows.setdefault(r.conv_id, []))
        rows[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(rows.get(c, [])).encode()).hexdigest() for c in hashes} == hashes
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in own)) for own in rows.values())


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONVERSATION)
    assert conversations.report(none).count() == conversations.repaired(conversations.damaged(none)).count() == 0


PARTS = [" ", "  ", "\n", "\t", "a", "B", "'", "s", "'ll", "é", "é", "22", "...", ",", "\x1c", "\xa0", "　", "ß", "中", "😀", "<|endoftext|>", "<|endoftext", "|>", "aaaa", "\r\n", "\x00"]


def test_segment_tree_ids_are_the_librarys():
    rnd, library = random.Random(5), Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    odd = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ["ab" * 20_000, "x" * 50_001]
    codec = segment_bpe.loaded(catalog.BYTE_TOKENIZER, public_tokenizers.PATTERN)
    ids, bounds = codec.encode(*chunks.bytes_of(pa.array(odd)))
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == want
    text, ends = codec.decode(ids, bounds)
    assert [text[a:b].tobytes().decode() for a, b in itertools.pairwise(ends)] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_pair_tree():
    rnd = random.Random(7)
    for n in (1, 2, 5, 8, 13):
        ranks = [rnd.randrange(4) for _ in range(n)]
        tree = segment_bpe.PairTree(list(ranks))
        for _ in range(40):
            least = min(ranks)
            assert tree.first() == (ranks.index(least) if least != segment_bpe.NO_MERGE else -1)
            at = rnd.randrange(n)
            ranks[at] = rnd.choice([segment_bpe.NO_MERGE, rnd.randrange(4)])
            tree.set(at, ranks[at])


@pytest.mark.parametrize("which", ["docs", "edge_docs"])
def test_segment_round_trip(request, which):
    given, library = request.getfixturevalue(which), Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    want = Counter()
    for r in given.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, segment_bpe.round_trip(given, catalog.BYTE_TOKENIZER, public_tokenizers.PATTERN).collect())) == want


def test_decoding_of_broken_ids(spark):
    """Bytes that are no UTF-8 decode as in the library; null ids are none."""
    library = Tokenizer.from_file(catalog.BYTE_TOKENIZER)
    rows = [(1, [167, 50256, 98]), (2, None), (3, [])]
    frame = spark.createDataFrame([(i, None if x is None else bytearray(b"".join(t.to_bytes(4, "little") for t in x))) for i, x in rows], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in segment_bpe.decode(frame, catalog.BYTE_TOKENIZER, public_tokenizers.PATTERN).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}
