"""The prefix trie against plain Python over whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie(spark, rows):
    from almanack.llm.prefix_trie import conversation_trie

    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth string, key string"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(kind == "bigint" for _, kind in got.dtypes[:7])
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0]))


def test_against_plain_python(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 90), *range(-12, 0), 10_001]:
        copied = c % 3 == 0
        for t in range(rng.randint(1, 7) if not copied else 9):
            said = f"turn {t}" if copied or rng.random() < 0.5 else rng.choice(["a", "b", "é" * 20, "", None])
            rows.append((c, t, rng.choice(["user", None]) if not copied else "user", said, "n", "d", "k"))
    rows += [(200, t, "user", f"long {t}", "", "", "") for t in range(2500)]  # longer than a run of numbered turns
    rows += [(201, t, "user", f"long {t}", "", "", "") for t in range(12)]
    rng.shuffle(rows)
    assert trie(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """A null turn comes first, null role or text is empty, no conv_id is no conversation, a conversation can end without turns."""
    rows = [(0, None, "r", "first"), (0, 1, None, None), (0, 0, "r", "second"), (None, 0, "r", "nobody"), (7, 3, "r", "x"), (3, 5, "", ""), (3, 6, "", "é")]
    rows = [(*r, None, None, None) for r in rows]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows * 1)[0][:3] == (0, 0, None)
    same = [(c, 0, "u", "t", "", "", "") for c in range(10_000)]
    assert trie(spark, same) == brute(same)


def test_repeated_rows_are_turns(spark):
    rows = [(c, t // 2, "u", f"t{t // 2}", "", "", "") for c in (0, 1, 2, 5) for t in range(6)]
    assert trie(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "t", "", "", "")]) == []
