"""Secret scans and personal data against Python's regular expressions."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from ffspark.llm import pii, secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRETS = [
    None, "", "token = abcdef", "Token:'abc'", "token: token: abcdef1", "API_KEY=\"abc123/x\" apikey : zzzzzz", "password=passwd=secret=abcdef", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 8, "xAKIA" + "Z9" * 20,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "ABC0123456789abcdef0123456789", "token=abcdef x", "\U0001f600 secret=abcdef\U0001f600" + "a" * 30, "PASSWD = 'abcdef'token=ABCDEF",
    "tokKen=abcdefg", "token\t=abcdef", "token  =  abcdef", "f" * 200_000, "token=" * 5000, "secret=" + "x" * 100_000,
]


def frame(spark, texts, ids=None):
    rows = [(ids[k] if ids else k, t, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, blob string, found string").repartition(3)


def secrets_of(t):
    t = t or ""
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s)


def sha(spans):
    return hashlib.sha256(spans.encode()).hexdigest()


def test_secrets(spark):
    got = secret_scan.two_pushes(frame(spark, SECRETS)).collect()
    assert len(got) == len(SECRETS)
    for r in got:
        want = secrets_of(SECRETS[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (r.spans, r.base_sha256) == (text, sha(text)), r.doc_id
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
    assert by_sql(secret_scan.oracle_sql(), SECRETS) == {r.doc_id: r.asDict() for r in got}
    assert secret_scan.two_pushes(frame(spark, SECRETS).limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", secret_scan.scan_blobs(frame(spark, SECRETS).selectExpr("blob", "text", "array('hex:1') AS missing"), secret_scan.RULES)._jdf.queryExecution().executedPlan().toString())


def test_a_push_reads_its_part_of_the_ledger(spark, tmp_path):
    """Of a kept ledger only folders of the push's digests are read, and only rows of its blobs go on; two scans may add at
    once."""
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    texts = [f"token=abcdef{k}" for k in range(400)]
    first = ledger.scan(frame(spark, texts), path_col="doc_id").count()
    assert first == 400 and ledger.read().count() == 1200
    push = spark.createDataFrame([(k, f"token=abcdef{k}") for k in (1, 2, 3)] + [(9, "token=zzzzzz")], "path long, text string")
    blobs = push.select(F.sha2("text", 256).alias("blob"))
    plan = ledger.of(blobs)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and 9 <= ledger.of(blobs).count() < 120
    found = ledger.scan(push)
    assert {r.path: len(r.found) for r in found.collect()} == {1: 1, 2: 1, 3: 1, 9: 1} and ledger.read().count() == 1203
    assert len({x.name for x in (tmp_path / "ledger").iterdir() if x.name.startswith("scan=")}) == 2


def test_ledger_scans_only_what_is_new(spark):
    v1 = frame(spark, ["token=abcdef", "nothing", None], [1, 2, 3]).withColumnRenamed("doc_id", "path")
    findings, added = secret_scan.scan_versions(v1)
    assert added.count() == 9 and findings.count() == 3
    v2 = frame(spark, ["token=abcdef", "token=zzzzzz", "nothing", "nothing"], [1, 2, 4, None]).withColumnRenamed("doc_id", "path")
    findings, more = secret_scan.scan_versions(v2, added)
    assert more.count() == 3 and more.select("blob").distinct().count() == 1
    assert {r.path: len(r.found) for r in findings.collect()} == {1: 1, 2: 1, 4: 0, None: 0}
    newer = (*secret_scan.RULES[:2], secret_scan.RULES[2]._replace(version=2))
    findings, third = secret_scan.scan_versions(v2, added.unionByName(more), newer)
    assert {(r.rule, r.rule_version) for r in third.collect()} == {("hex", 2)} and third.count() == 3
    assert {r.path: len(r.found) for r in findings.collect()} == {1: 1, 2: 1, 4: 0, None: 0}


def test_a_kept_ledger(spark, tmp_path, monkeypatch):
    """Each pair of blob and rule version is scanned once over all runs, however many paths and pushes have it."""
    pairs = []
    scan = secret_scan.scan_blobs
    monkeypatch.setattr(secret_scan, "scan_blobs", lambda b, r: pairs.append(b.select(F.explode("missing")).count()) or scan(b, r))
    path = str(tmp_path / "ledger")
    first = secret_scan.secret_findings(frame(spark, SECRETS[:9]), secret_scan.BlobLedger(spark, path)).collect()
    every = secret_scan.secret_findings(frame(spark, SECRETS + SECRETS), secret_scan.BlobLedger(spark, path)).collect()
    again = secret_scan.secret_findings(frame(spark, SECRETS), secret_scan.BlobLedger(spark, path)).collect()
    distinct = [len({t or "" for t in SECRETS[:k]}) for k in (9, len(SECRETS))]
    assert pairs == [3 * distinct[0], 3 * (distinct[1] - distinct[0]), 0]
    assert {(r.doc_id % len(SECRETS), r.spans) for r in every} == {(r.doc_id, r.spans) for r in again} >= {(r.doc_id, r.spans) for r in first}
    newer = (*secret_scan.RULES[:2], secret_scan.RULES[2]._replace(version=2))
    secret_scan.secret_findings(frame(spark, SECRETS), secret_scan.BlobLedger(spark, path), rules=newer)
    assert pairs[3] == distinct[1]


def test_scan_of_copies_and_missing_ids(spark):
    texts = ["token=abcdef"] * 40 + ["token=abcdef"] * 40 + [None] * 5
    got = secret_scan.two_pushes(frame(spark, texts, [*range(40), *[None] * 40, *[7] * 5])).collect()
    assert len(got) == 85 and sum(r.n_assign for r in got) == 80


def luhn(x):
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0


def personal_of(t):
    t = t or ""
    n = lambda x: sum(c.isdigit() for c in x)
    s = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    s += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= n(m[0]) <= 19 and luhn(m[0])]
    s += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= n(m[0]) <= 15]
    return s


PERSONAL = [
    None, "", "a@b.c", "a@b", "x a.b+c%d@e-f.gh.ij. y", "a@b.c@d.e", "x@y.com_z@w.org", "@a.b a@.b a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.4", "1.2.3", "999999999999.1.1.1", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "4111 1111 1111 1111 0", "4111  1111", "+1 (743) 555-3824", "+1 2", "+12345678", "+123456789", "+1234567890123456", "+1 +1 555 555 5555", "4111111111111111+1 555 555 5555", "\U0001f600 a@b.c 1.1.1.1",
    "a" * 5_000, "1" * 5_000, "a." * 20_000 + "@b.c", "a@b" + ".c" * 20_000, "1." * 5_000, "+1" + "-" * 5_000 + "2", "1 " * 20_000, "١.٢.3.4 +1٣ 555 555 555",
]


def by_sql(sql, texts):
    """Rows by id of the SQL over a table of these texts, by column name."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rel = con.sql(sql)
    return {r[0]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()}


def test_personal_data(spark):
    got = pii.personal_data(frame(spark, PERSONAL)).collect()
    assert len(got) == len(PERSONAL)
    for r in got:
        want = personal_of(PERSONAL[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == sha(text), (r.doc_id, text[:200], r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text
    assert pii.personal_data(frame(spark, PERSONAL).limit(0)).count() == 0


def test_long_runs(spark):
    """No pattern starts anew at every character of a run."""
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, ["a" * 200_000, "1" * 200_000 + ".", "é" * 200_000])).collect()}
    assert got == {0: "", 1: "", 2: ""}


def test_bootstrapping_discovers(spark):
    texts = [f"Please write to user{k}@mail.example.com for more." for k in range(12)]
    texts += ["Please write to bob99@intranet for more.", "The year was 1999 and 20 men came.", "you write to agent007 at once"]
    texts += [f"The year was {k} and many came." for k in range(1900, 1920)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    at = texts[12].index("bob99")
    assert got[12].spans == f"email:{at}:{at + len('bob99@intranet')}" and got[12].n_found == 1 and got[12].n_email == 0
    assert got[12].base_sha256 == sha("")
    assert by_sql(pii.oracle_sql(), texts) == {k: r.asDict() for k, r in got.items()}
    assert all(got[k].spans == "" for k in range(13, len(texts)))


def test_recall_on_planted_identifiers(spark):
    """Identifiers that no base pattern matches, after or before words that seeds have taught; numbers among words that all
    kinds and look-alikes share stay."""
    rng = random.Random(5)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = {
        "email": ("reach me under", lambda: f"user{number(4)}@mail.example.com", lambda: f"user{number(4)}@intranet"),
        "ip": ("login from host", lambda: f"10.0.{rng.randrange(256)}.{rng.randrange(256)}", lambda: f"10.0.{number(2)}.x{number(2)}"),
        "phone": ("call us at", lambda: f"+1{number(10)}", lambda: f"0{number(9)}"),
    }
    texts, planted = [], {}
    for kind, (words, seed, unseen) in kinds.items():
        texts += [f"{filler()} {words} {seed()} {filler()}" for _ in range(40)]
        for _ in range(20):
            planted[len(texts)] = (kind, value := unseen())
            texts.append(f"{filler()} {words} {value} {filler()}")
    plain = len(texts)
    for _ in range(60):
        texts.append(f"{filler()} of the {rng.choice([k[1]() for k in kinds.values()])} {filler()}")
        texts.append(f"{filler()} of the {number(16)} {filler()}")
    long = "x" * 300 + "7"
    texts += [f"call us at {long}"]
    lookalikes = [f"{filler()} call us at {x} today" for x in ("9am", "10:30", "room7", "12", "7/8")] + ["reach me under agent007 now", "login from host db7 now", "login from host 3.11 now"]
    texts += lookalikes
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    caught = sum(got[k].spans == f"{kind}:{texts[k].index(v)}:{texts[k].index(v) + len(v)}" for k, (kind, v) in planted.items())
    assert caught >= 0.9 * len(planted)
    assert by_sql(pii.oracle_sql(), texts) == {k: r.asDict() for k, r in got.items()}
    assert all(got[k].n_found == 0 for k in range(plain, plain + 120))
    found = [k for k, r in got.items() if r.n_found]
    assert sum(k in planted for k in found) >= 0.95 * len(found)
    assert all(got[k].spans == "" for k in range(plain + 120, len(texts))) and all(r.n_spans == r.spans.count(":") // 2 for r in got.values())
