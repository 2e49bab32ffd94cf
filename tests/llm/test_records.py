"""Web archives, conversation repair and hard negatives against plain Python, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import conversations, hard_negatives, query_records, residue_gemm, role_grammar, warc

FOLDER = "/root/testdata/sf0.001"


# -- web archives ---------------------------------------------------------------

BIG = "<p>é 🙂</p>" * 20
PAGES = [
    (5, "http://a b\r\nX-Evil: 1/é", BIG), (3, "u3", BIG), (9, None, BIG), (3, "u3", BIG), (None, "n", BIG), (4, "u", "short"),
    (2, "u", "short"), (7, "u7", None), (8, "u8", ""), (1, "é", "in it\r\n\r\nWARC/1.0\r\n" * 9), (6, "v", "x" * 100), (10, "w", "x" * 100),
    (11, "w", "x" * 99), (12, "w", "x" * 99), (13, "long", "y" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string, digest string, payload int, type int"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1, 2) for p in PAGES], SCHEMA)


def archived(spark, pages, folder):
    warc.write_archive(pages, str(folder / "archive"))
    return warc.read_archive(spark, str(folder / "archive"))


def test_types_and_payloads(spark, pages, tmp_path):
    rows = archived(spark, pages, tmp_path).collect()
    assert len(rows) == len(PAGES)
    want = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        least = min((k for k, _, h in PAGES if (h or "").encode() == body and k is not None), default=None)
        again = len(body) >= 100 and least is not None and key != least
        want.append((key, "revisit" if again else "response", least if again else None, body))
    assert sorted(((r.record_key, r.type, r.refers_to, bytes(r.payload)) for r in rows), key=repr) == sorted(want, key=repr)


def test_heads(spark, pages, tmp_path):
    named = {}
    rows = archived(spark, pages, tmp_path).collect()
    for r in rows:
        fields, http, rest = bytes(r.head).decode().split("\r\n\r\n")
        assert rest == "" and fields.startswith("WARC/1.1\r\n") and "\r\nX-Evil" not in fields
        given = dict(line.split(": ", 1) for line in fields.split("\r\n")[1:])
        assert given["WARC-Type"] == r.type
        assert given["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()
        block = len(http.encode()) + 4 + (len(r.payload) if r.type == "response" else 0)
        assert int(given["Content-Length"]) == block and f"Content-Length: {len(r.payload)}" in http
        named[r.record_key] = given["WARC-Record-ID"]
    for r in rows:
        if r.type == "revisit":
            assert f"WARC-Refers-To: {named[r.refers_to]}\r\n" in bytes(r.head).decode()


def test_payloads_are_stored_once_and_in_slices(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 2)
    whole = archived(spark, pages, tmp_path).select("record_key", F.octet_length("payload").alias("n")).collect()
    assert len(whole) == len(PAGES) and sum(r.n for r in whole) == sum(len((h or "").encode()) for _, _, h in PAGES)
    stored = spark.read.parquet(str(tmp_path / "archive" / "payloads")).collect()
    assert len(stored) == len({(h or "") for _, _, h in PAGES})
    assert max(r.slices for r in stored) == 3


@pytest.mark.parametrize("share", [1, 10**9])
def test_hot_and_other_digests_take_the_same_types(spark, pages, tmp_path, monkeypatch, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    test_types_and_payloads(spark, pages, tmp_path)


@pytest.mark.parametrize("compressed", [True, False])
def test_files_give_the_same_bytes(spark, pages, tmp_path, compressed):
    records = archived(spark, pages, tmp_path)
    warc.write_warc(records, str(tmp_path / "files"), compressed)
    back = warc.read_warc(spark, str(tmp_path / "files")).collect()
    want = sorted((r.type, bytes(r.head), b"" if r.type == "revisit" else bytes(r.payload)) for r in records.collect())
    assert sorted((r.type, bytes(r.head), bytes(r.payload)) for r in back) == want
    assert not any(r.broken for r in back)


def test_cut_files_are_marked(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    text = head.format(5) + "12345\r\n\r\n" + head.format(9) + "1234"
    (tmp_path / "one.warc").write_bytes(text.encode())
    rows = warc.read_warc(spark, str(tmp_path / "one.warc")).collect()
    assert [(bytes(r.payload), r.broken) for r in rows] == [(b"12345", False), (b"1234", True)]


def test_damage_is_found(spark, pages, tmp_path):
    archived(spark, pages, tmp_path)
    stored = spark.read.parquet(str(tmp_path / "archive" / "payloads"))
    stored.withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(str(tmp_path / "bad" / "payloads"))
    spark.read.parquet(str(tmp_path / "archive" / "heads")).write.parquet(str(tmp_path / "bad" / "heads"))
    with pytest.raises(Exception, match="missing or damaged payload"):
        warc.read_archive(spark, str(tmp_path / "bad")).collect()


def test_two_payloads_under_one_digest_are_not_stored(spark):
    found = spark.createDataFrame([(1, b"a", "d"), (2, b"b", "d"), (3, b"c", "e"), (4, b"c", "e")], "record_key long, payload binary, digest string")
    assert {r.digest: r.same for r in warc.stored_payloads(found).collect()} == {"d": False, "e": True}


def test_no_pages(spark, pages, tmp_path):
    assert archived(spark, pages.limit(0), tmp_path).collect() == []


# -- conversations ----------------------------------------------------------------

def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def well_formed(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def all_repairs(rows):
    """Every way to edit a few rows, as (cost, audit, lines)."""
    gaps = ["", "u", "a", "ua", "au"]
    full = {"u": "user", "a": "assistant"}
    choices = []
    for (role, text), fault in zip(rows, fault_of(rows)):
        ways = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            ways += [(more, "K", role)] * (role != "") + [(more + 1, "R", r) for r in full.values()]
        choices.append([(c, e, None if r is None else (r, text)) for c, e, r in ways])
    best = None
    for edits in itertools.product(*choices):
        for given in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for gap, edit in itertools.zip_longest(given, edits):
                cost += 5 * len(gap)
                audit += "I" * len(gap)
                lines += [(full[g], "") for g in gap]
                if edit is not None:
                    cost, audit = cost + edit[0], audit + edit[1]
                    lines += [edit[2]] if edit[2] else []
            if well_formed("".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def planned(rows):
    """The same by a table over row, and four places in the grammar; inserts allowed everywhere."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    def with_inserts(now):
        todo = list(now)
        while todo:
            at = todo.pop()
            for r in "ua":
                if (to := step.get((at, r))) is not None:
                    cost, audit, lines = now[at]
                    new = (cost + 5, audit + "I", lines + [(full[r], "")])
                    if to not in now or new[:2] < now[to][:2]:
                        now[to] = new
                        todo.append(to)
        return now

    now = with_inserts({"0": (0, "", [])})
    for (role, text), fault in zip(rows, fault_of(rows)):
        after = {}

        def offer(to, cost, audit, lines):
            if to not in after or (cost, audit) < after[to][:2]:
                after[to] = (cost, audit, lines)

        for at, (cost, audit, lines) in now.items():
            offer(at, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (to := step.get((at, role[:1]))) is not None:
                offer(to, cost + more, audit + "K", lines + [(role, text)])
            for r in "ua":
                if (to := step.get((at, r))) is not None:
                    offer(to, cost + more + 1, audit + "R", lines + [(full[r], text)])
        now = with_inserts(after)
    return min((now[at] for at in "0p" if at in now), key=lambda way: way[:2])


def random_rows(rng, count):
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", "So. ", "tail.\n", "x…"]
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), rng.choice(texts)) for _ in range(count)]


def repaired(rows):
    repair = role_grammar.Repair(GRAMMAR)
    for (role, text), fault in zip(rows, fault_of(rows)):
        repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    return repair.result()


GRAMMAR = role_grammar.Grammar()


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_repair_is_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(60):
        rows = random_rows(rng, rng.choice([0, 1, 2, 2]))
        cost, audit, lines = all_repairs(rows)
        assert repaired(rows) == (cost, audit, "".join(r[0] for r, _ in lines), digest(lines)), rows


def test_repair_of_longer_conversations():
    rng = random.Random(4)
    for _ in range(1500):
        rows = random_rows(rng, rng.randrange(16))
        cost, audit, lines = planned(rows)
        assert repaired(rows) == (cost, audit, "".join(r[0] for r, _ in lines), digest(lines)), rows


def test_stacks_are_shared():
    rng = random.Random(5)
    repaired(random_rows(rng, 3000))
    assert len(GRAMMAR.stacks) < 20


def test_another_grammar():
    """Pairs only, the user may speak twice; the two ways to read a turn share their stacks."""
    grammar = role_grammar.Grammar((("C", "T"), ("T", "P"), ("T", "TP"), ("P", "ua"), ("P", "uua")), "C")
    for roles, want in (("ua", (0, "KK")), ("uua", (0, "KKK")), ("uaua", (0, "KKKK")), ("a", (5, "IK")), ("aua", (1, "RKK")), ("", (10, "II"))):
        repair = role_grammar.Repair(grammar)
        for n, r in enumerate(roles):
            repair.row({"u": "user", "a": "assistant"}[r], f"{n}.", False, False)
        assert repair.result()[:2] == want, roles


def plain_damage(rows):
    """What the contract says of each conversation of ``(conv_id, turn, role, text)`` rows."""
    after = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        place = ":".join(" " if v is None else str(v) for v in (c, turn))
        fault = zlib.crc32(place.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        after[c] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, found in after.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in found if t is not None]
        lines = [(r, t) for _, r, t in found]
        faults = fault_of(lines)
        cost, audit, fixed = planned(lines)
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:])), cost, audit, digest(fixed))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = query_records.op12_repair_conversations(spark, FOLDER).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain_damage(rows)


def odd_conversations():
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None, ""]),
             rng.choice(["Yes.", "No", None, "", "é🙂?", " \t", "long. " * 20_000])) for _ in range(400)]
    return rows + rows[:20]


def test_repair_of_odd_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, last int")
    got = conversations.repair_conversations(conversations.damage(df)).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain_damage(rows)
    assert conversations.repair_conversations(conversations.damage(df.limit(0))).collect() == []


def test_a_conversation_runs_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_repair_of_odd_rows(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_repaired_rows(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    rows = conversations.damage(df)
    repairs = conversations.repair_conversations(rows)
    got = {}
    for r in conversations.repaired_rows(rows, repairs).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for r in repairs.collect():
        lines = got.get(r.conv_id, [])
        assert [p for p, _, _ in lines] == list(range(len(lines)))
        assert digest([line[1:] for line in lines]) == r.repaired_sha256


# -- hard negatives -------------------------------------------------------------------

@pytest.mark.parametrize("scale, dim", [(1, 1), (256, 64), (256, 1000), (2**20, 64), (2**26, 300)])
def test_products_are_exact(scale, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-scale, scale + 1, (40, dim)), rng.integers(-scale, scale + 1, (50, dim))
    a[0], b[0], b[1] = scale, -scale, scale
    primes = residue_gemm.primes_for(scale * scale * dim)
    got = residue_gemm.ResidueMatrix(a, primes).scores(residue_gemm.ResidueMatrix(b, primes))
    assert (got == a.astype(object) @ b.T.astype(object)).all()


def plain_negatives(rows):
    """``(vec_id, vector, label)`` rows, labels as they are."""
    kept = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v):
            kept[(i, label, tuple(int(np.floor(256 * np.float64(x))) for x in v))] = None

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = set()
    for anchor in {i for i, *_ in kept if i % 100 == 0}:
        _, label, vector = min(k for k in kept if k[0] == anchor)
        scored = [(i, lab, dot(v, vector)) for i, lab, v in kept]
        near = sorted({(-s, i) for i, lab, s in scored if lab == label and i != anchor})[:5]
        for s, i in near:
            fits = sorted({(-n, j) for j, lab, n in scored if lab != label and 30 * -s <= 100 * n <= 90 * -s})[:10]
            out |= {(anchor, i, rank, j, -s, -n) for rank, (n, j) in enumerate(fits, 1)}
    return out


def mined(df):
    found = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found]


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(1)], int(rng.integers(3))) for i in range(-200, 500)]
    rows += rows[100:110] + [(100, [0.5] * 6, 1), (None, [1.0] * 6, 1), (700, None, 1), (800, [1.0] * 6, None)]
    rows += [(900, [1.0, None, 1.0], 1), (901, [float("nan")] * 6, 1), (902, [float("inf")] * 6, 1), (1000, [2.0, 2.0], 2), (903, [], 1), (1100, [], 1)]
    return rows + [(2000 + i, [1.0] * 6, i % 2) for i in range(150)]


SHAPE = "vec_id long, embedding array<float>, label int"


def test_negatives_of_odd_rows(spark):
    df = spark.createDataFrame(odd_vectors(), SHAPE).withColumn("size", F.lit("x")).withColumn("rank", F.lit("x"))
    got = mined(df)
    assert len(got) == len(set(got)) and set(got) == plain_negatives([(i, None if v is None else [None if x is None else np.float32(x) for x in v], l) for i, v, l in odd_vectors()])
    assert mined(df.limit(0)) == []


def test_negatives_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_SLAB", 60)
    monkeypatch.setattr(hard_negatives, "SLABS", 10**6)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "SCORES", 100)
    test_negatives_of_odd_rows(spark)


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SHAPE)
    with pytest.raises(ArithmeticError):
        mined(df)
