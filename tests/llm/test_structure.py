"""Repeated passages, the Merkle manifest and the conversation trie against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import merkle, substrings, tries
from tidemark.llm.common import Scratch, numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, tie long, place long, pos int, tree string"
CONVS = "conv_id long, turn long, role string, text string, depth int, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_numbered_counts_every_key_from_zero(spark):
    rng = random.Random(1)
    given = [(None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 5}", rng.randint(0, 40) or None) for k in range(500)]
    got = numbered(spark.createDataFrame(given, "k string, v int").repartition(5), ["k"], ["v"], Scratch(spark)).collect()
    for key in {k for k, _ in given}:
        mine = sorted(((r["pos"], r["v"]) for r in got if r["k"] == key))
        assert [v for _, v in mine] == sorted((v for k, v in given if k == key), key=lambda v: (v is not None, v))
        assert [p for p, _ in mine] == list(range(len(mine))) and {r["n"] for r in got if r["k"] == key} == {len(mine)}


# Repeated passages


def brute_repeats(rows, length):
    """(n_words, n_removed, kept) of each row; windows in order of (id, checksum, start)."""
    split = [((t or "").encode().split(), (i is not None, i or 0, zlib.crc32((t or "").encode()))) for i, t in rows]
    first = {}
    for words, at in split:
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            first[window] = min(first.get(window, (at, k)), (at, k))
    out = []
    for words, at in split:
        gone = {p for k in range(len(words) - length + 1) if first[tuple(words[k : k + length])] != (at, k) for p in range(k, k + length)}
        out.append((len(words), len(gone), b" ".join(w for p, w in enumerate(words) if p not in gone).decode()))
    return out


def passages(seed, n, alphabet):
    """Texts of few words, with copies, near copies, shared passages and one very common line."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(alphabet) for _ in range(k)]
    shared, line = [words(rng.randint(10, 60)) for _ in range(5)], words(30)
    out = []
    for i in range(n):
        t = words(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(t))
            t = t[:cut] + rng.choice(shared + [line] * 3) + t[cut:]
        if out and rng.random() < 0.3:
            t = list(rng.choice(out))
            if t and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "edit"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("seed,alphabet,length,anchor", [(1, "ab", 20, 8), (2, [f"w{k}" for k in range(300)], 20, 8), (3, "a", 20, 8), (4, ["x", "é", "　", "日本"], 6, 3), (5, [f"w{k}" for k in range(9)], 1, 1)])
def test_repeats_equal_brute_force(spark, seed, alphabet, length, anchor):
    ids = list(range(40))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, passages(seed, 40, list(alphabet))))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), length=length, anchor=anchor)
    want = collections.Counter((i, *r) for (i, _), r in zip(rows, brute_repeats(rows, length)))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == want


def test_repeats_of_hostile_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(30000))
    texts = [None, "", " \t\n", "one two", long, long, "a\x1cb " * 30, " ".join("abcdefghijklmnopqrstuvw")]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, long), (7, "tail " + texts[7]), (None, texts[7]), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", 5, 6, 7, "y") for i, t in rows], DOCS).repartition(3)
    got = substrings.remove_repeats(df)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == collections.Counter((i, *r) for (i, _), r in zip(rows, brute_repeats(rows, 20)))
    spans = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in got.where("doc_id is not null").collect()}
    assert spans[5] == [(0, 30000)] and spans[4] == [(700, 30000)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_anchors_of_one_batch_and_of_many_meet(spark):
    """Very small batches, so that an anchor's extensions are told across tasks."""
    rows = list(enumerate(passages(9, 60, [f"w{k}" for k in range(40)])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == collections.Counter((i, *r) for (i, _), r in zip(rows, brute_repeats(rows, 20)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# The manifest


def h(*parts):
    return sha("".join(parts))


def brute_tree(level):
    """The top of a list of digests, and the siblings (left, right) of each leaf on its way up."""
    above, at = [[] for _ in level], [[k] for k in range(len(level))]
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for k, leaves in enumerate(at):
            run = runs[k // 3]
            for leaf in leaves:
                above[leaf].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        at = [sum(at[k : k + 3], []) for k in range(0, len(at), 3)]
        level = [h(*run) for run in runs]
    return level[0], above


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: h(*map(field, (i, s, g, n, t)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, crown = brute_tree([tops[s][0] for s in names])
    out = collections.Counter()
    for s, over in zip(names, crown):
        for (_, _, mine, (i, _, g, n, t)), below in zip(sorted(by[s], key=lambda x: x[:3]), tops[s][1]):
            path = below + over
            now = leaf(i, s, g, n, t and t.replace("\n", "")) if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else mine
            for a, b in path:
                now = h(a, now, b)
            out[(i, mine, tops[s][0], root, h(*(a + b for a, b in path)), now, now == root)] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels,sources", [(1, 30), (2, 4), (6, 1)])
def test_manifest_equals_brute_force(spark, levels, sources):
    """Also where every level is a round of its own, for leaves and for sources."""
    rng = random.Random(levels)
    rows = [(i, None if i % 17 == 0 else f"é{rng.randrange(sources)}" if i % 3 else "hot", rng.choice(["en", None]), i, rng.choice([f"a\nb{i}", f"c{i}", "", None])) for i in range(300)]
    rows += [rows[5], (None, "hot", None, None, "x\ny"), (None, None, None, None, None), (-4, "alone", "en", 1, "\n")]
    df = spark.createDataFrame([(i, t, g, s, n, "x", 1, 2, 3, "y") for i, s, g, n, t in rows], DOCS).repartition(5)
    assert rows_of(merkle.verify(merkle.merkle_manifest(df, levels)), *COLUMNS) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_few_leaves(spark, n):
    rows = [(i, "s", "en", 1, "x" * 40_000 if i == 0 else "t") for i in range(n)]
    df = spark.createDataFrame([(i, t, g, s, k, "x", 1, 2, 3, "y") for i, s, g, k, t in rows], DOCS)
    got = merkle.verify(merkle.merkle_manifest(df, 2))
    assert rows_of(got, *COLUMNS) == (brute_manifest(rows) if rows else collections.Counter())


# The trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        k = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:k] + ts[k:]
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed, n):
    """Conversations with a common first turn, exact copies, missing heads, ties and nulls."""
    rng = random.Random(seed)
    rows, last = [], []
    for c in rng.sample(range(100, 900), n) + [0, 200]:
        turns = [rng.choice([("user", "hi"), (None, "yo"), ("bot", None), ("bot", "é日" * rng.randint(1, 3))]) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.5:
            turns[0] = ("user", "Hello there")
        if last and rng.random() < 0.4:
            turns = rng.choice(last)
        last.append(turns)
        rows += [(c, None if k == 0 and c % 7 == 0 else k, *t) for k, t in enumerate(turns)]
    return rows + [rows[3], rows[9], (None, 0, "user", "nobody")]


@pytest.mark.parametrize("segment,shard", [(256, 200_000), (3, 200_000), (2, 40), (1, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, shard):
    """Also where conversations are cut and shards are small, so that nodes are merged."""
    monkeypatch.setattr(tries, "SEGMENT", segment)
    rows = talks(segment, 90)
    # Workers read the module again, so that the sizes are set where they are used.
    build = tries._build

    def small(batches):
        from tidemark.llm import tries as there

        there.SEGMENT, there.SHARD = segment, shard
        yield from build(batches)

    monkeypatch.setattr(tries, "_build", small)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVS).repartition(5)
    assert rows_of(tries.conversation_trie(df), *TRIE) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    """7 has fewer turns than it skips and no head; long turns count in full."""
    skips = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(skips, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVS)
    assert rows_of(tries.conversation_trie(df), *TRIE) == brute_trie(rows)
    assert rows_of(tries.conversation_trie(df), "depth", "n_leaves") == {(0, 1): 1}
    assert tries.conversation_trie(df.limit(0)).count() == 0


def test_double_array_holds_exactly_its_sequences():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 40, rng.integers(0, 9)).tolist() for _ in range(400)] + [[k] for k in range(40)]
    lengths = np.array([len(s) for s in sequences])
    trie, walk = tries.shard_nodes(np.zeros(len(sequences), np.int64), np.array(sum(sequences, []), np.int64), lengths)
    states = {s for _, at, _ in walk for s in at.tolist()}
    prefixes = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    assert len(states) == len(prefixes) and min(states) > 0
    assert (trie.check >= 0).sum() == len(prefixes) + 1
    for probe in rng.integers(0, 40, (300, 3)).tolist():
        state = trie.step(np.zeros(1, np.int64), np.zeros(1, np.int64))
        for d, turn in enumerate(probe):
            state = trie.step(state, np.array([turn]))
            assert (state[0] >= 0) == (tuple(probe[: d + 1]) in prefixes)
            if state[0] < 0:
                break
