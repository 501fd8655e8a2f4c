import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stewardry.llm import prefix_trie as trie
from stewardry.llm.frames import table

OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, path string, tie long"


def turns_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for *_, r, t in sorted(x)) for c, x in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), ())[:h] + turns[h:]
    return out


def brute(own):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    for node, own_members in members.items():
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below[node] if n)
        out.append((
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), children[node],
            sum(children[n] == 0 for n in below[node]), saved,
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r[c] for c in OUT) for r in df.collect()], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)


def many(seed, n):
    """Conversations with long shared beginnings, one of them in hundreds of copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        deep = int(rng.integers(0, 9))
        kind = rng.integers(0, 3)
        for t in range(deep):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" * t if kind == 0 else f"é{int(rng.integers(0, 2))}" if kind == 1 else "x"))
    rows += [(10_000 + c, t, "user", f"copy {t}") for c in range(n // 2) for t in range(3)]
    rows += [(20_000, t, "user", f"deep {t % 3}") for t in range(400)] + [(20_001, t, "user", f"deep {t % 3}") for t in range(390)]
    return rows


@pytest.mark.parametrize("shard", [4, 16, 100, 1 << 15])
def test_shards_agree_with_brute_force(spark, sf_dir, monkeypatch, shard):
    """Many levels of shards, in which spines run through whole shards, give the same nodes."""
    rows = many(1, 250)
    monkeypatch.setattr(trie, "SHARD", shard)
    assert found(trie.prefix_nodes(frame(spark, rows))) == brute(turns_of(rows))


def levels(paths, shard):
    """The levels of :func:`trie.nodes` in one process."""
    level = sorted((p, c, None) for c, p in paths.items())
    nodes, ends, above = [], defaultdict(list), {}
    while True:
        whole = len(level) <= shard
        parts = [level] if whole else [level[i : i + shard] for i in range(0, len(level), shard)]
        level = []
        for part in parts:
            for row in trie.shard_rows(*map(list, zip(*part, strict=True)), whole):
                r = dict(zip(trie.NAMES, row, strict=True))
                if r["kind"] == "node":
                    nodes.append(r)
                    if r["node"] is not None:
                        above[r["node"]] = r["conv_id"]
                elif r["kind"] == "ends":
                    ends[r["node"]].append((r["tie"], r["ends"]))
                else:
                    level.append((r["path"], r["tie"], r["sums"]))
        if whole:
            break
        level.sort(key=lambda x: x[:2])
    out = []
    for r in nodes:
        if r["ends"] is None:
            r["ends"] = hashlib.sha256(b",".join(e for _, e in sorted(ends.get(r["node"], [])))).hexdigest().encode()
        if r["parent"] is not None:
            r["parent_conv_id"] = above[r["parent"]]
        out.append(tuple(r[c] if c != "ends_sha256" else r["ends"].decode() for c in OUT))
    return sorted(out, key=repr)


def unit(role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    return digest + len(text).to_bytes(4, "big")


@settings(max_examples=150, deadline=None)
@given(
    st.dictionaries(st.integers(-50, 400), st.lists(st.sampled_from([("user", "a"), ("bot", "bb"), ("user", "")]), max_size=6), min_size=1, max_size=40),
    st.sampled_from([5, 7, 20]),
)
def test_any_cut_into_shards(conversations, shard):
    own = {c: tuple(t) for c, t in conversations.items()}
    assert levels({c: b"".join(unit(*t) for t in turns) for c, turns in own.items()}, shard) == brute(own)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=700))
def test_findclose(steps):
    bits, open_now = [True], 1
    for up in steps:
        if up or open_now > 1:
            bits.append(up)
            open_now += 1 if up else -1
    bits += [False] * open_now
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    shape = trie.Parentheses(np.array(bits))
    opens = np.flatnonzero(bits)
    closes = shape.findclose(opens)
    assert closes.tolist() == [want[i] for i in opens]
    leaves = [sum(want[j] == j + 1 for j in opens if i <= j <= want[i]) for i in opens]
    assert shape.leaves(opens, closes).tolist() == leaves


def test_odd_rows(spark, sf_dir):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", "b"), (1, 0, "user", "b"),
        (None, 0, "user", "lost"), (2, 5, "user", "x" * 300_000), (-7, 1, "user", "first"), (-7, None, "user", "first"),
        (3, 1, "us", "erfirst"), (4, 1, "user", "first"), (150, 0, "user", "🙂é"), (100, 0, "user", "🙂é"),
    ]
    assert found(trie.prefix_nodes(frame(spark, rows))) == brute(turns_of(rows))
    assert found(trie.nodes(trie.rebuilt(trie.units(frame(spark, rows))))) == brute(rebuilt(turns_of(rows)))
    assert trie.prefix_nodes(frame(spark, rows).filter("false")).count() == 0


def test_given_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 20)
    conversations = table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.nodes(trie.rebuilt(trie.units(conversations)))) == brute(rebuilt(turns_of(rows)))
