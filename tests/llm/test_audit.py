"""Filter audit, decontamination and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellis.llm import conversations as conv
from trellis.llm import decontaminate as dec
from trellis.llm import filter_audit as fa
from trellis.llm.common import bytes_of

# 11 filter audit


def test_posting_lists_merge_as_sets():
    rnd = random.Random(3)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(60), rnd.choice([0, 1, 5, 40]))) for _ in range(4)]
        a, others = lists[0], lists[1:]
        assert fa.difference(a, others) == sorted(set(a).difference(*others))
        assert fa.union(lists) == sorted(set().union(*lists))
        assert fa.common_size(a, others[0]) == len(set(a) & set(others[0]))
    assert fa.union([]) == [] and fa.gallop([1, 3, 5], 4, 0) == 2 and fa.gallop([], 4, 0) == 0


def plain_audit(docs, labels):
    """Filters one by one over row numbers; docs: (doc_id, text, lang)."""
    fails = {f: set() for f in fa.FILTERS}
    for row, (i, t, _) in enumerate(docs):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails["A"] |= {row} if len(words) < 100 else set()
        fails["B"] |= {row} if 100 * len(set(words)) < 80 * len(words) else set()
        fails["C"] |= {row} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails["D"] |= {row} if re.search(r"[#$%&*|]", t) else set()
        fails["E"] |= {row} if any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
    good = {row for row, d in enumerate(docs) if any(i == d[0] is not None and q == 1 for i, q, _ in labels)}
    toxic = {row for row, d in enumerate(docs) if any(i == d[0] is not None and x == 1 for i, _, x in labels)}
    out = {}
    for part in {d[2] or "" for d in docs}:
        rows = {row for row, d in enumerate(docs) if (d[2] or "") == part}
        shapley = dict.fromkeys(fa.FILTERS, 0)
        for order in itertools.permutations(fa.FILTERS):
            left = set(rows)
            for step, f in enumerate(order, 1):
                gone, left = left & fails[f], left - fails[f]
                others = set().union(*[fails[g] for g in fa.FILTERS if g != f])
                out[part, "".join(order), step] = [len(left), len(gone), len(rows & fails[f]) - len(gone),
                                                   len(rows & fails[f] - others), len(gone & good), len(gone & toxic)]
                shapley[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rnd = random.Random(9)
    docs = []
    for i in range(70):
        words = [f"w{rnd.randint(0, rnd.choice([20, 5000]))}" for _ in range(rnd.choice([3, 99, 100, 130]))]
        words += rnd.choice([[], ["A#"], ["LOUD"] * 90])
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(words), rnd.choice(["en", "de", None])))
    docs += [(i + 100, docs[rnd.randrange(70)][1], rnd.choice(["en", "fr"])) for i in range(30)]
    docs += [(200, None, "en"), (201, "", "en"), (None, docs[0][1], "en"), (7, docs[3][1], "en"), (7, docs[3][1], "en")]
    labels = [(d[0], rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for d in docs if rnd.random() < 0.6]
    return docs, labels + labels[:5] + [(None, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("block_rows", [7, 1 << 15])
def test_audit_equals_plain_version(spark, block_rows):
    docs, labels = audit_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("bits", F.lit(1))
    got = fa.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), block_rows=block_rows).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in got} == plain_audit(docs, labels)
    assert len(got) == 4 * 600


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fa.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 12 decontamination

def test_suffix_order_of_repeats():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 50, 400):
        for top in (1, 2, 300):
            codes = np.append(rnd.integers(1, top + 1, n), 0)
            want = sorted(range(n + 1), key=lambda i: codes[i:].tolist())
            assert dec.suffix_order(codes, top + 1).tolist() == want


@pytest.mark.parametrize("copies", [1, 4])
def test_fm_index_finds_every_occurrence(copies):
    rnd = random.Random(copies)
    for _ in range(12):
        texts = [" ".join(rnd.choice("ab c d ee F".split()) for _ in range(rnd.choice([0, 1, 3, 12, 30]))) for _ in range(8)] * copies
        items = [(str(i), " ".join(rnd.choice("AB c d ee f zz".split()) for _ in range(rnd.choice([0, 1, 2, 3, 5])))) for i in range(6)]
        index = dec.FMIndex.load(dec.FMIndex.build(*bytes_of(pa.array(texts, pa.large_string()))).dump())
        phrases = dec.Phrases(items, 3)
        which, place = phrases.occurrences(index)
        got = {(phrases.names[i], int(p), int(phrases.lengths[w])) for w, p in zip(which, place)
               for i in phrases.items[phrases.first[w]:phrases.first[w + 1]]}
        want, base = set(), 0
        for t in texts:
            t = t.lower().split()
            for name, item in items:
                item = item.lower().split()
                n = min(3, len(item))
                windows = [item[k:k + n] for k in range(len(item) - n + 1)] if n else []
                want |= {(name, base + p, n) for p in range(len(t) - n + 1) if n and t[p:p + n] in windows}
            base += len(t) + 1
        assert got == want and len(which) == len(set(zip(which.tolist(), place.tolist())))


def test_words_with_equal_hashes_are_told_apart():
    a, b = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    first, second, symbols = dec.dictionary(a, b)
    assert first.tolist() == [5, 5, 9] and second.tolist() == [1, 2, 3] and symbols.tolist() == [0, 1, 2, 0]
    index = dec.FMIndex.build(*bytes_of(pa.array(["x"], pa.large_string())))
    index.hashes, index.seconds = first, second
    assert index.symbols(np.array([5, 5, 5, 9, 1, 10], np.uint64), np.array([2, 1, 7, 3, 1, 1], np.uint64)).tolist() == [2, 1, 0, 3, 0, 0]


def plain_contamination(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            item = words(item)
            n = min(window, len(item))
            windows = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found.add(name)
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,shard_bytes", [(1 << 24, 1 << 22), (200, 300)])
def test_contamination_equals_plain_version(spark, block_bytes, shard_bytes):
    rnd = random.Random(4)
    vocabulary = "the of naïve straße 日本 x1 and stone river ÄRGER Under".split()

    def text(n):
        return rnd.choice([" ", "-", ", "]).join(rnd.choice(vocabulary) for _ in range(n))

    items = [(f"{i}", text(rnd.choice([2, 4, 9, 20]))) for i in range(12)] + [("a", None), ("b", ""), ("c", "!!"), (None, text(3))]
    items += [("10", items[3][1]), ("3", items[3][1])]
    docs = [(i, text(rnd.choice([0, 1, 5, 80]))) for i in range(40)]
    docs += [(100 + i, "one two " + items[i % 12][1].upper() + " end") for i in range(24)]
    docs += [(200, None), (201, ""), (None, items[3][1]), (100, docs[40][1]), (202, (items[3][1] + " ") * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("digest", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = dec.contamination(df, bench, window=4, block_bytes=block_bytes, shard_bytes=shard_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)),
                    sorted({x for x in r["items"] if x is not None})) for r in got), key=str) == plain_contamination(docs, items, 4)
    assert all(e < s for r in got for e, s in zip(r.ends, r.starts[1:]))


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = dec.contamination(docs, none).collect()[0]
    assert (row.doc_id, row.n_words, row.starts, row["items"]) == (1, 2, [], [])
    assert dec.contamination(docs.limit(0), none).count() == 0


def test_phrases_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "So: Alpha beta, gamma delta! End.", "k"), (1, "other", "k"), (2, None, "k"), (3, "alpha beta gamma", "k")],
                                 "doc_id long, text string, digest string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {(r.doc_id, r.text) for r in dec.decontaminate(docs, items).collect()}
    assert got == {(1, "So:  delta! End."), (1, "other"), (2, None), (3, "")}


# 13 conversation repair

def test_linked_strings_compare_as_text():
    rnd = random.Random(6)
    tree, nodes = conv.Strings(), {0: ""}
    for _ in range(400):
        parent = rnd.choice(list(nodes))
        letter = rnd.choice("DIKR")
        nodes[tree.add(parent, ord(letter))] = nodes[parent] + letter
    for _ in range(4000):
        a, b = rnd.choice(list(nodes)), rnd.choice(list(nodes))
        assert tree.compare(a, b) == (nodes[a] > nodes[b]) - (nodes[a] < nodes[b])
        assert tree.text(a) == nodes[a]


def test_equal_hashes_of_different_strings(monkeypatch):
    monkeypatch.setattr(conv, "_BASE", 0)  # the hash is that of the last symbol
    tree, nodes = conv.Strings(), {}
    for text in map("".join, itertools.product("DK", repeat=5)):
        node = 0
        for c in text:
            node = tree.add(node, ord(c))
        nodes[node] = text
    for a, b in itertools.product(nodes, nodes):
        assert tree.compare(a, b) == (nodes[a] > nodes[b]) - (nodes[a] < nodes[b])


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows, brute=True):
    """rows: (turn, role, text) after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append(1 if not kept.strip(" \t\n\r\x0b\x0c") else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    stats = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
             sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))
    if not brute:
        return stats
    best = (3 * len(rows), "D" * len(rows), "")

    def walk(i, cost, audit, lines):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)):
            best = min(best, (cost, audit, "\n".join(lines)))
        for role in ("user", "assistant"):
            walk(i, cost + 2, audit + "I", [*lines, role + ":"])
        if i < len(rows):
            _, role, text = rows[i]
            walk(i + 1, cost + 3, audit + "D", lines)
            if faults[i] not in (1, 2):
                extra = faults[i] == 3
                walk(i + 1, cost + extra, audit + "K", [*lines, f"{role}:{text}"] if role else [*lines, ":" + text])
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 2 + extra, audit + "R", [*lines, f"{new}:{text}"])

    walk(0, 0, "", [])
    return (*stats, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def conversation_rows():
    rnd = random.Random(12)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rnd.choice([f"Text {rnd.randint(0, 9)}.", f"Cut {rnd.randint(0, 9)}", "", " \n", None, "Same! \n", " ", "é?"])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")] + [(70, 3, "user", "A.")] * 3


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"a.b!{t}?") for c in range(40) for t in (1, 2, None)] + [(None, None, None, None)]
    got = [tuple(r) for r in conv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
           .where("not gone").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=str) == sorted(plain_damage(rows), key=str)


def by_conversation(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, role, text))
    # the order that the operator defines where turns are equal (these texts are short)
    for c in out:
        ties = out[c]
        out[c] = sorted(ties, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    return out


@pytest.mark.parametrize("block", [1 << 10, 4, 1])
def test_repair_equals_brute_force(spark, block):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    damaged = by_conversation(plain_damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in conv.repair(conv.damaged(df), block).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, want in got.items():
        assert want == plain_repair(damaged.get(c, [])), (c, damaged.get(c))


def test_long_conversation_over_many_pieces(spark):
    """A conversation of a third of all rows: pieces give what one piece gives."""
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", f"Word {t}.", f"Cut {t}", ""])) for t in range(900)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"{t}.") for c in range(2, 200) for t in range(9)]
    df = conv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {r.conv_id: tuple(r) for r in conv.repair(df).collect()}
    split = {r.conv_id: tuple(r) for r in conv.repair(df, 64).collect()}
    assert whole == split and len(whole) == 199
    assert tuple(whole[1][1:6]) == plain_repair(by_conversation(plain_damage(rows))[1], brute=False)


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(conv.damaged(df)).count() == 0
