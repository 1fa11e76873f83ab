"""The prefix trie against a plain model that walks dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

from spindrift.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def model(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))  # remainders have the sign of c
        turns = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_tokens = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_tokens + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()) if members else []


def run(spark, rows):
    made = trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))
    return sorted((tuple(r) for r in made.collect()), key=lambda r: (r[0], r[1]))


def test_random_conversations_with_nulls_and_ties(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 200, 205, 311, *range(-105, -95)]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([t, t, t, None, 0]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "é漢", None, "", "long " * 20])))
    rows += [(None, 0, "user", "x"), (7, 1, "user", "same"), (7, 1, "user", "same")]
    assert run(spark, rows) == model(rows)


def test_many_copies_and_one_deep_conversation(spark):
    rows = [(1000 + 100 * i, t, "user", f"turn {t}") for i in range(300) for t in range(8)]
    rows += [(5, t, "user", f"deep {t % 7}") for t in range(4000)] + [(6, t, "user", f"deep {t % 7}") for t in range(2500)]
    assert run(spark, rows) == model(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.rebuilt_trie(empty).count() == 0
    rows = [(105, 0, "user", "only one")]  # h of 105 is over its turns, and conversation 100 is absent
    clash = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", digest int, depth string")
    assert [tuple(r) for r in trie.rebuilt_trie(clash).collect()] == model(rows)


def test_digests_of_ends_in_blocks(spark):
    rows = [(bytes([k]), i * 3 + k) for k in range(3) for i in range((1, 50, 977)[k])]
    ends = spark.createDataFrame(rows, "digest binary, conv_id long").repartition(5)
    want = {bytes([k]): hashlib.sha256(",".join(str(c) for d, c in rows if d == bytes([k])).encode()).hexdigest() for k in range(3)}
    for block in (1, 7, 4096):
        assert {bytes(r.digest): r.ends_sha256 for r in trie.end_digests(ends, block).collect()} == want
