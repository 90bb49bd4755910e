import json
import sys

import pytest
from pyspark.sql import functions as F

from spanveil.functions import validators as V
from spanveil.functions.patterns import SPECS
from spanveil.operators import audit, detect, engine, judge, model, plugins, policy, quality, sanitize, sql, transform, tree, validate, vault, windows
from spanveil.operators.store import VaultStore, create_key, encrypt_in_place, read_key
from spanveil.plans import fixtures
from spanveil.sources.config import Settings, matrix, report, resolve, tool_names
from spanveil.streaming import lifecycle, requests

KEY = b"k" * 32


def kinds(spark, text):
    rows = detect.inspect(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return sorted((r.kind, text.encode()[r.start : r.end].decode()) for r in rows)


def test_kinds_at_exact_spans(spark):
    key = "sk-" + "a1" * 10
    text = f"é mail a.b@mail.org, card 4111 1111 1111 1111, {key} ssn 123-45-6789 ip 10.0.0.1 bad 999.1.1.1 v6 2001:db8::1"
    assert kinds(spark, text) == sorted([("email", "a.b@mail.org"), ("credit_card", "4111 1111 1111 1111"), ("api_key", key), ("ssn", "123-45-6789"), ("ipv4", "10.0.0.1"), ("ipv6", "2001:db8::1")])


def test_pages_with_other_letters_and_spaces_as_in_sql(spark, tmp_path):
    """Word boundaries and white space beside letters, digits and spaces that aren't ASCII, against the query's SQL."""
    import random

    import duckdb

    from spanveil.plans.queries import QUERIES, SQL

    r = random.Random(4)
    values = ["token = &quot;592951daa87bc4fa6f2</h1><p><b>Ñraboó, lo", "4111 1111 1111 1111", "123-45-6789", "a.b@mail.org", "10.0.0.1", "2001:db8::1", "bearer abcdefgh12", "pa\u017f\u017fword:\u00a0abcdefgh1", "to\u212aen=abcd\x0befgh", "sk-" + "a1" * 10, "GB82 WEST 1234 5698 7654 32", "+49 151 2345678"]
    glue = ["", " ", "é", "ó", "\u00a0", "\x0b", "\u2003", "\u0663", "_", "<b>", "界", "\u0301"]
    texts = values[:1] + ["".join(r.choice(glue) + r.choice([*values, "é", "word"]) for _ in range(r.randrange(1, 5))) + r.choice(glue) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(x) for x in QUERIES["inspect_pages"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted((*x[:4], round(x[4], 2)) for x in con.execute(SQL["inspect_pages"]).fetchall())
    assert got == want and len({k for _, k, *_ in got}) >= 8 and got[0][:4] == (0, "generic_secret", 0, len(texts[0].encode()) - 6)


def test_all_kinds_of_generated_values(spark):
    import re

    rows = fixtures.generated()
    df = spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string")
    got = {}
    for r in detect.inspect(df).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end))
    python = {s.kind: re.compile(s.pattern) for s in SPECS}
    for i, kind, value, text in rows:
        at = len(text[: text.index(value)].encode())
        m = next(m for m in python[kind].finditer(text) if m.group() == value)
        assert (kind, at, at + len(value.encode())) in got[i] and m, (kind, value)
    assert {k for _, k, _, _ in rows} == {s.kind for s in SPECS} and len(SPECS) == 27
    for kind, text in fixtures.lookalikes():
        assert kind not in {k for k, _ in kinds(spark, text)}, (kind, text)


def test_addresses_are_found_as_by_a_plain_search(spark):
    import random
    import re

    r = random.Random(4)
    email = next(s for s in SPECS if s.kind == "email")
    texts = ["".join(r.choice(["a", "b1", ".", "-", "@", "@x.org", " ", "_", "%", "é", "ſ", "\n", "..", "org"]) for _ in range(r.randrange(3, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = df.select("doc_id", F.regexp_extract_all("text", F.lit(email.java), F.lit(0)).alias("m"), F.split("text", email.java, -1).alias("g")).collect()
    for x in found:
        m = re.findall(email.pattern, texts[x.doc_id])
        assert x.m == m and x.g == re.split(email.pattern, texts[x.doc_id]), texts[x.doc_id]
    assert sum(len(x.m) for x in found) > 300


def test_ipv6_against_the_standard_library(spark):
    import ipaddress
    import random

    r = random.Random(2)
    values = [str(ipaddress.IPv6Address(r.getrandbits(128) & r.choice([-1, (1 << 64) - 1, ~((1 << 96) - 1), 0xFFFF << 64 | 1]))) for _ in range(60)]
    values = [v for v in values if v != "::"] + ["::ffff:1.2.3.4", "2001:db8::10.0.0.1", "1:2:3:4:5:6:7:8"]
    rows = [(i, f"to {v}, then") for i, v in enumerate(values)]
    got = {x.doc_id: (x.start, x.end) for x in detect.inspect(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'ipv6'").collect()}
    assert got == {i: (3, 3 + len(v)) for i, v in enumerate(values)}


def test_lookalikes_and_empties(spark):
    assert kinds(spark, "é4111111111111112 and 12-3 plain words") == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert detect.inspect(df).count() == 0 and sanitize.sanitize(df).select("status").collect()[0][0] == "error"


def test_checksums(spark):
    one = lambda f, v: spark.range(1).select(f(F.lit(v))).first()[0]
    assert one(V.luhn_valid, "4111-1111 1111 1111") and not one(V.luhn_valid, "4111111111111112")
    assert one(V.iban_valid, "DE89 3704 0044 0532 0130 00") and not one(V.iban_valid, "DE88 3704 0044 0532 0130 00")
    assert one(V.aba_valid, "021000021") and not one(V.aba_valid, "021000022")
    assert one(V.ipv4_valid, "1.2.3.255") and not one(V.ipv4_valid, "1.2.3.256")
    assert not one(V.jurisdiction_valid, "de\n") and one(V.is_minted, "__DO_PRIVATE_EMAIL_1_0123456789ABCDEF__")


def test_overlaps(spark):
    def kept(spans):
        rows = [("k", a, b, "v", 0.5, a, b, i) for i, (a, b) in enumerate(spans)]
        df = spark.createDataFrame([(rows,)], f"e {detect.ENTITY}")
        return [(r.start, r.end) for r in df.select(detect.resolve_overlaps(F.col("e")).alias("r")).first().r]

    assert kept([(0, 3), (3, 6)]) == [(0, 3), (3, 6)]
    assert kept([(0, 3), (1, 9)]) == [(1, 9)]
    assert kept([(2, 5), (0, 3)]) == [(2, 5)]
    assert kept([]) == []
    import random

    r = random.Random(7)
    for _ in range(12):
        spans = [(a, a + r.randrange(1, 12)) for a in (r.randrange(90) for _ in range(r.randrange(1, 25)))]
        want: list = []
        for a, b, _ in sorted(((a, b, i) for i, (a, b) in enumerate(spans)), key=lambda x: (x[0] - x[1], x[2])):
            if all(b <= c or d <= a for c, d in want):
                want.append((a, b))
        assert kept(spans) == sorted(want)


def test_judge(spark):
    rows = [("email", "a@example.com", "test"), ("email", "a@mail5.example.com", "personal"), ("email", "Sales@corp.de", "business"), ("phone", "12345678", "personal"), ("ssn", "1", None), ("api_key", "a@b.test", None)]
    got = spark.createDataFrame(rows, "k string, v string, w string").select("w", judge.label(F.col("k"), F.col("v")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_policies_differ_on_unknown_special(spark):
    ctx = policy.Context("unknown", "special_category").columns()
    r = spark.range(1).select(policy.default_policy(F.lit("email"), ctx).alias("d"), policy.matrix_policy(F.lit("email"), ctx, policy.Matrix()).alias("m")).first()
    assert (r.d.reason, r.m.reason) == ("special_category_blocked", "unknown_recipient_blocked")


def test_mask_counts_characters(spark):
    got = [r[0] for r in spark.createDataFrame([("äöüß",), ("éé@x.de",), ("",)], "v string").select(transform.masked(F.col("v"))).collect()]
    assert got == ["****", "***x.de", ""]


def test_restore_inverts_pseudonymize(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.org and 10.0.0.1", "s"), (2, "a@b.org", "s"), (3, "a@b.org", "t"), (4, "none", "s"), (5, "a@b.org a@b.orgx", "s")], "doc_id long, text string, source string")
    rows, full = sanitize.pseudonymize(df, key=KEY)
    out = {r.doc_id: r for r in rows.collect()}
    assert out[2].clean_text in out[1].clean_text and out[2].clean_text != out[3].clean_text and out[5].status == "ok"
    store = VaultStore(spark, f"file://{tmp_path}/vault", KEY)
    assert store.read() is None
    store.write(full)
    back = vault.restore(rows.where("status = 'ok'"), store.read(), key="doc_id", text="clean_text", scope="source").collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in df.collect() if out[r.doc_id].status == "ok"}
    again = vault.get_or_insert(full.select("scope", "kind", "original", F.lit(0).alias("first")), full, KEY)
    assert again.count() == full.count()
    assert vault.live(full.withColumn("created_at", F.lit(0)), 10, 10).count() == 0 and vault.forget(full, "s").count() == 1


def test_hmac_and_canary(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(vault.hmac_sha256(b"key", F.lit("mé")).alias("h"), audit.verify_canary(F.concat(F.lit("x"), audit.marker(audit.canary(KEY, F.lit("s")))), KEY, F.lit("s")).alias("ok")).first()
    assert got.h == hmac.new(b"key", "mé".encode(), hashlib.sha256).hexdigest() and got.ok
    with pytest.raises(ValueError):
        audit.canary(b"short", F.lit("s"))


@pytest.mark.parametrize("change,want", [(None, None), ("event", "hash"), ("previous_hash", "linkage"), ("gone", "sequence")])
def test_audit_chain(spark, change, want):
    import hashlib

    log = audit.chain(spark.createDataFrame([("c", i, f"e{i}") for i in range(5)], "c string, o int, e string"), by="c", order="o", event="e")
    last = "0" * 64
    for n, r in enumerate(log.orderBy("sequence").collect(), 1):
        last = hashlib.sha256(last.encode() + n.to_bytes(8, "big") + f"e{n - 1}".encode()).hexdigest()
        assert (r.sequence, r.record_hash) == (n, last)
    if change == "gone":
        log = log.where("sequence <> 2")
    elif change:
        log = log.withColumn(change, F.when(F.col("sequence") == 3, F.lit("x")).otherwise(F.col(change)))
    r = audit.verify(log, by="c").first()
    assert r.failure == want and r.at == (3 if want else None) and r.records == (4 if change == "gone" else 5)


def test_audit_sink_goes_on_rotates_and_refuses(spark, tmp_path):
    events = lambda *x: spark.createDataFrame([(i, e) for i, e in enumerate(x)], "o int, event string")
    sink = audit.AuditSink(spark, f"file://{tmp_path}/audit", max_records=3)
    sink.append(events("a", "b"), batch=0)
    sink.append(events("c", "d"), batch=1)
    sink.append(events("c", "d"), batch=1)
    rows = sink.read().orderBy("generation", "sequence").collect()
    assert [(r.generation, r.sequence, r.event) for r in rows] == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "d")]
    assert rows[3].previous_hash == audit.GENESIS and {r.failure for r in sink.verify().collect()} == {None}
    sink.append(events(), batch=2)
    sink.append(events("e"))
    assert sink.read().count() == 5 and sink.batches() == [0, 1, 2, 3]
    small = audit.AuditSink(spark, f"file://{tmp_path}/small", max_bytes=450)
    small.append(events("x" * 10, "y" * 10, "z" * 10))
    assert [r.generation for r in small.read().orderBy("event").collect()] == [0, 0, 1]
    bad = sink.read().where("event = 'e'").withColumn("event", F.lit("f"))
    bad.write.parquet(f"file://{tmp_path}/audit/batch=9")
    with pytest.raises(ValueError):
        sink.append(events("g"))
    with pytest.raises(ValueError):
        audit.check_paths(vault="file:/a/b", audit="/a/b/c")


def test_audit_events_and_files(spark):
    row = spark.createDataFrame([([("email", "pseudonymize"), ("jwt", "redact"), ("email", "keep"), ("email", "keep")],)], "plan array<struct<kind:string,action:string>>")
    e = row.select(audit.event("sanitize", outcome=F.lit("ok"), session=F.lit("s"), now=F.lit(5), actions=audit.counted(F.col("plan")), context=policy.Context().columns()).alias("e")).first().e
    assert e == '{"actions":[{"action":"Keep","count":2,"kind":"email"},{"action":"Pseudonymize","count":1,"kind":"email"},{"action":"Redact","count":1,"kind":"jwt"}],"context":{"data_category":"personal","jurisdiction":null,"recipient":"external"},"operation":"sanitize","outcome":"ok","resolved":null,"session":"s","time_unix":5}'
    log = audit.chain(spark.createDataFrame([("c", 1, e), ("c", 2, e)], "c string, o int, e string"), by="c", order="o", event="e").orderBy("sequence")
    text = "\n".join(r.line for r in log.select(audit.line().alias("line")).collect())
    files = {"whole": text + "\n", "cut": text, "legacy": e + "\n", "none": None, "extra": text.replace('{"v":2', '{"v":2,"x":1') + "\n"}
    got = {r.f: r for r in audit.verify_files(spark.createDataFrame(list(files.items()), "f string, t string"), by="f", contents="t").collect()}
    assert {k: (r.report, r.records, r.failure, r["at"]) for k, r in got.items()} == {"whole": ("verified", 2, None, None), "cut": ("failure", None, "truncated", 0), "legacy": ("legacy", 1, None, None), "none": ("empty", 0, None, None), "extra": ("failure", None, "not_envelope", 1)}


def test_bio_and_windows(spark):
    toks = [("B-name", 0, 3, 0.0), ("I-name", 3, 6, 2.0), ("O", 7, 8, 1.0), ("I-city", 9, 12, 1.0), ("B-city", 0, 0, 9.0)]
    df = spark.createDataFrame([(toks,)], "t array<struct<tag:string,start:int,end:int,logit:double>>")
    assert [(r.kind, r.start, r.end) for r in df.select(windows.bio_decode(F.col("t")).alias("s")).first().s] == [("name", 0, 6), ("city", 9, 12)]
    w = windows.char_windows(spark.createDataFrame([("é" * 10,), ("",), (None,)], "text string"), size=4, overlap=1).collect()
    assert [(r.byte_start, r.piece) for r in w] == [(0, "éééé"), (6, "éééé"), (12, "éééé")]


def test_quality_scores(spark):
    t = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 0, 2), (1, "b", 3, 4)], "doc_id int, kind string, start int, end int")
    f = spark.createDataFrame([(1, "a", 0, 2), (2, "b", 3, 4)], t.schema)
    r = {x.kind: x for x in quality.score_spans(t, f, ["doc_id"]).collect()}
    assert (r["a"].tp, r["a"].fn, r["b"].fp, r[None].tp) == (1, 1, 1, 1) and r["b"].precision == 0


CHILD = """import json, sys, time
q = json.loads(sys.stdin.readline())
m, t = q["method"], q.get("input", "")
def out(x):
    print(json.dumps(x)); sys.exit()
if t == "die": sys.exit(3)
if t == "bad": print("x"); sys.exit()
if t == "two": print("{}"); print("{}"); sys.exit()
if t == "hang": time.sleep(60)
if t == "big": print("x" * (9 << 20)); sys.exit()
if m == "detect":
    i = t.find("SEC"); a = len(t[:i].encode())
    out({"entities": [{"kind": "My Kind", "start": a, "end": a + 3}] if i >= 0 else [], **({} if t == "none" else {"text": t})})
if m == "judge":
    out({"judgments": [{"index": 0, "label": "test" if "odd" not in t else "zap", "confidence": 0.95}]})
if m == "plan":
    e = q["entities"]
    out({"plan": [{"index": i, "action": "redact" if q["recipient"] == "unknown" else "pseudonymize"} for i in range(len(e))][: 0 if any(x["value"] == "SEC" and q.get("purpose") == "short" for x in e) else None]})
if m == "transform":
    text, maps = q["input"], []
    for i, p in enumerate(q["plan"]):
        token = "__DO_PRIVATE_MY_%d__" % (i + 1)
        text = text.replace(p["value"], token if p["action"] == "pseudonymize" else "gone") if "leak" not in t else text + token
        if p["action"] == "pseudonymize": maps.append({"kind": p["kind"], "original": p["value"], "token": token})
    out({"text": text, "mappings": maps})
if m == "vault_get_or_insert": out({"token": "__DO_PRIVATE_" + q["original"] + "__" if q["original"] != "form" else "x"})
if m == "vault_resolve":
    o = q["token"][13:-2]
    out({"mapping": None if o == "lost" else {"kind": "k", "original": o, "token": q["token"]}})
if m == "vault_delete_scope": out({"deleted": q["scope"] == "s"})
"""


@pytest.fixture
def child(tmp_path):
    path = tmp_path / "child.py"
    path.write_text(CHILD)
    return [sys.executable, str(path)]


def test_process_detector(spark, child):
    df = spark.createDataFrame([(1, "é SEC"), (2, "die"), (3, "bad"), (4, None), (5, "two"), (6, "big"), (7, "none"), (8, "hang")], "doc_id long, text string")
    got = {r.doc_id: r for r in plugins.detect_with(df, child, timeout=8).collect()}
    assert [(e.kind, e.start, e.end, e.cp_start) for e in got[1].entities] == [("my_kind", 3, 6, 2)] and got[4].entities == []
    assert [got[i].plugin_error for i in (2, 3, 5, 6, 7, 8)] == ["exit_code", "not_json", "not_one_object", "oversized", "entities", "timeout"]
    with pytest.raises(plugins.PluginError):
        plugins.call(["/no/such/program"], {})


def test_checks_of_plugin_answers():
    code = lambda f, *a: (pytest.raises(plugins.PluginError, f, *a).value.args[0])
    j = lambda **x: {"judgments": [{"index": 0, "label": "test", "confidence": 0.5} | x]}
    assert [code(plugins.check_judgments, 1, x) for x in ({}, j(index=1), j(index="0"), {"judgments": j()["judgments"] * 2}, j(label="zap"), j(confidence=2), j(confidence=None))] == ["judgments_index"] * 3 + ["judgments_duplicate", "judgments_label"] + ["judgments_confidence"] * 2
    assert plugins.check_judgments(1, j(label=None))[0]["label"] is None
    p = lambda *x: {"plan": [{"index": i, "action": a} for i, a in x]}
    assert [code(plugins.check_plan, 2, x) for x in (p((0, "keep")), p((0, "keep"), (0, "keep")), p((0, "keep"), (1, "zap")))] == ["plan_coverage", "plan_duplicate", "plan_action"]
    plan = [{"kind": "k", "value": "aa", "action": "pseudonymize"}, {"kind": "k", "value": "bb", "action": "redact"}, {"kind": "k", "value": "cc", "action": "keep"}]
    m = lambda t, o="aa", k="k": {"kind": k, "original": o, "token": t}
    tok, two = "__DO_PRIVATE_X_1__", "__DO_PRIVATE_X_2__"
    assert plugins.check_transform(plan, {"text": f"{tok} cc", "mappings": [m(tok)]})["text"] == f"{tok} cc"
    bad = [{"text": 1}, {"text": f"{tok} cc", "mappings": [m(tok), m(tok)]}, {"text": "x cc", "mappings": [m("x")]}, {"text": f"{tok}{two} cc", "mappings": [m(tok), m(two, "zz")]}, {"text": "cc", "mappings": [m(tok)]}, {"text": "cc", "mappings": []}, {"text": tok, "mappings": [m(tok)]}, {"text": f"{tok} bb cc", "mappings": [m(tok)]}]
    assert [code(plugins.check_transform, plan, x) for x in bad] == [f"transform_{x}" for x in ("form", "token_twice", "token_form", "unplanned", "token_missing", "uncovered", "kept_missing", "leak")]


def test_pipeline_of_process_stages(spark, child, tmp_path):
    df = spark.createDataFrame([(1, "a SEC b", "s"), (2, "nothing", "s"), (3, "die", "s"), (4, "SEC odd", "s"), (5, "leak SEC", "s"), (6, None, "s")], "doc_id long, text string, scope string")
    program = " ".join(child)
    s = Settings(detector="process", judge="process", policy="process", transformer="process", detector_program=program, judge_program=program, policy_program=program, transformer_program=program, vault_path=f"file://{tmp_path}/v", audit_path=f"file://{tmp_path}/a")
    p = engine.build(spark, s)
    got = {r.doc_id: r for r in engine.run(p, df, now=7).collect()}
    assert (got[1].status, got[1].clean_text) == ("ok", "a __DO_PRIVATE_MY_1__ b") and got[2].clean_text == "nothing"
    assert [(got[i].status, got[i].error) for i in (3, 4, 5, 6)] == [("error", "exit_code"), ("error", "judgments_label"), ("error", "transform_leak"), ("error", "no_text")]
    assert p.sink.read().count() == 6 and p.store.read().first().original == "SEC"
    s.policy_program = None
    with pytest.raises(engine.UnknownStage):
        engine.run(p, df).collect()
    with pytest.raises(engine.UnknownStage):
        engine.build(spark, Settings(detector="nope"))


def test_process_vault(spark, child):
    v = plugins.ProcessVault(child)
    rows = [("s", "k", x) for x in ("fine", "lost", "form", "fine")] + [("s", "other", "fine")]
    got = {(r.kind, r.original): (r.token, r.plugin_error) for r in v.mint(spark.createDataFrame(rows, "scope string, kind string, original string")).collect()}
    assert got == {("k", "fine"): ("__DO_PRIVATE_fine__", None), ("k", "lost"): (None, "vault_round_trip"), ("k", "form"): (None, "vault_token_form"), ("other", "fine"): (None, "vault_round_trip")}
    back = v.resolve(spark.createDataFrame([("s", "__DO_PRIVATE_fine__"), ("s", "__DO_PRIVATE_lost__")], "scope string, token string")).collect()
    assert {r.token: r.original for r in back} == {"__DO_PRIVATE_fine__": "fine", "__DO_PRIVATE_lost__": None}
    v.forget("s")
    with pytest.raises(plugins.PluginError):
        v.forget("t")


def test_settings_pipeline_keeps_vault_and_audit(spark, tmp_path):
    key = tmp_path / "key"
    create_key(str(key))
    assert len(read_key(str(key))) == 32 and oct(key.stat().st_mode & 0o777) == "0o600"
    with pytest.raises(FileExistsError):
        create_key(str(key))
    df = spark.createDataFrame([(1, "a@b.org and token = abcdefgh1", "s"), (2, "a@b.org", "s"), (3, "a@b.org", "t")], "doc_id long, text string, scope string")
    s = Settings(judge="heuristics", vault_path=f"file://{tmp_path}/v", vault_key_file=str(key), vault_ttl_seconds=100, audit_path=f"file://{tmp_path}/a")
    p = engine.build(spark, s)
    first = {r.doc_id: r.clean_text for r in engine.run(p, df, now=10, batch=0).collect()}
    assert first[2] in first[1] and first[2].startswith("__DO_PRIVATE_EMAIL_1_") and first[3] != first[2] and "abcdefgh1" not in first[1]
    back = {r.doc_id: (r.text, r.resolved) for r in engine.restore(p, spark.createDataFrame([(1, first[2], "s"), (2, first[2], "t")], df.schema), now=20, batch=1).collect()}
    assert back == {1: ("a@b.org", 1), 2: (first[2], 0)}
    later = engine.run(p, df, now=500, batch=2).where("doc_id = 2").first().clean_text
    assert later.startswith("__DO_PRIVATE_EMAIL_2_")  # the number of what expired isn't used again
    engine.forget(p, spark.createDataFrame([("s",)], "scope string"), now=600, batch=3)
    assert {r.scope for r in p.store.read().collect()} == {"t"} and {r.scope for r in p.store.read_both()[1].collect()} == {"t"}
    assert engine.run(p, df, now=700, batch=4).where("doc_id = 2").first().clean_text.startswith("__DO_PRIVATE_EMAIL_1_")
    ops = [json.loads(r.event) for r in p.sink.read().orderBy("sequence").collect()]
    assert [o["operation"] for o in ops] == ["sanitize"] * 3 + ["restore"] * 2 + ["sanitize"] * 3 + ["forget"] + ["sanitize"] * 3
    assert ops[0]["actions"] == [{"action": "Pseudonymize", "count": 1, "kind": "email"}, {"action": "Redact", "count": 1, "kind": "generic_secret"}] and ops[3]["resolved"] == 1
    assert p.sink.verify().first().failure is None and engine.build(spark, s)
    assert dict(engine.doctor(spark, s)) == {"detector": "ok", "judge": "ok", "policy": "ok", "transformer": "ok", "model": "unset", "programs": "ok", "vault_key": "ok", "canary_key": "unset", "paths": "ok", "audit": "ok"}
    with pytest.raises(ValueError):
        engine.build(spark, Settings(vault_path="/x", audit_path="/x", transformer="mask"))


def test_store_versions_and_lock(spark, tmp_path):
    path = f"file://{tmp_path}/vault"
    plain = VaultStore(spark, path)
    rows = vault.get_or_insert(spark.createDataFrame([("s", "email", "x@y.org", 1)], "scope string, kind string, original string, first int"), None, KEY)
    plain.write(rows)
    (tmp_path / "vault" / "v-000000000009-dead").mkdir()  # a writer that died
    assert plain.read().count() == 1 and plain.encrypted() is False
    with plain.lock(), pytest.raises(TimeoutError), plain.lock(wait=0.2):
        pass
    encrypt_in_place(spark, path, KEY)
    sealed = VaultStore(spark, path, KEY)
    assert sealed.read().first().original == "x@y.org" and plain.read().first().original != "x@y.org" and sealed.read_both()[1].first().value == 1
    with pytest.raises(ValueError):
        encrypt_in_place(spark, path, KEY)
    with pytest.raises(Exception, match="(?i)crypt|tag|mac"):
        VaultStore(spark, path, b"z" * 32).read().collect()
    assert KEY.hex().upper() not in sealed.read()._jdf.queryExecution().toString().upper()


def test_tokens_of_another_form_are_replaced(spark):
    old = spark.createDataFrame([("s", "email", "x@y.org", "__DO_PRIVATE_EMAIL_4__", 4, 0), ("s", "email", "other", "__DO_PRIVATE_EMAIL_5__", 5, 0)], "scope string, kind string, original string, token string, counter long, created_at long")
    wanted = spark.createDataFrame([("s", "email", "x@y.org", 1)], "scope string, kind string, original string, first int")
    full, top = vault.mint(wanted, old, None, KEY)
    got = {r.original: (r.counter, r.token[:23]) for r in full.collect()}
    assert got == {"x@y.org": (6, "__DO_PRIVATE_EMAIL_6_" + full.where("counter = 6").first().token[21:23]), "other": (5, "__DO_PRIVATE_EMAIL_5__"[:23])} and top.first().value == 6
    assert KEY.hex() not in full._jdf.queryExecution().toString()


def test_model_windows_and_tags(spark):
    text = "é1234 " * 900
    cuts = windows.byte_windows(spark.createDataFrame([(text,), ("",), (None,), ("😀" * 3,)], "text string"), size=64, overlap=9).collect()
    for t in (text, "😀" * 3):
        own = sorted((r.window_no, r.byte_start, r.byte_end, r.piece) for r in cuts if r.text == t)
        assert [(a, b) for _, a, b, _ in own] == model.windows(t.encode(), 64, 9) and all(t.encode()[a:b].decode() == p for _, a, b, p in own)
    assert len({r.text for r in cuts}) == 2
    scorer = lambda piece: [{"label": "Big Number", "start": m, "end": m + 4, "score": 0.9} for m in range(len(piece.encode()) - 4) if piece.encode()[m : m + 4] == b"1234"] + [{"label": "nan", "start": 0, "end": 1, "score": float("nan")}]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in model.detect_with_model(df, scorer, max_tokens=16).collect()}
    assert [(e.kind, e.start) for e in got[1].entities] == [("big_number", 2 + 7 * i) for i in range(900)] and got[2].entities == []
    assert {r.plugin_error for r in model.detect_with_model(df, None).collect()} == {"model_missing"} and model.probe(None, 512) == "model_missing" and model.probe(scorer, 8) == "token_budget" and model.probe(scorer, 16) == "ok"
    toks = [([0.0, 3.0, 1.0], 0, 3), ([0.0, 0.0, 2.0], 3, 6), ([5.0, 1.0, 1.0], 7, 8)]
    d = spark.createDataFrame([(toks,), ([([float("inf"), 0.0, 0.0], 0, 1)],)], "t array<struct<logits:array<double>,start:int,end:int>>")
    tags = d.select(windows.argmax_tags(F.col("t"), ("O", "B-name", "I-name")).alias("x"))
    assert [r.s and [(x.kind, x.start, x.end) for x in r.s] for r in tags.select(windows.bio_decode(F.col("x")).alias("s")).collect()] == [[("name", 0, 6)], None]
    s = engine.build(spark, Settings(detector="hybrid", transformer="mask"), scorer=scorer)
    mixed = engine.run(s, spark.createDataFrame([(1, "a@b.org 1234 x", "s")], "doc_id long, text string, scope string")).first()
    assert mixed.clean_text == "***.org **** x"


def test_trees_fail_closed(spark):
    part = lambda t: {"type": "text", "text": t}
    trees = {
        1: {"system": [part("to a@b.org")], "messages": [{"role": "user", "content": [part("a@b.org")]}], "tools": {}, "options": {"n": 1, "none": None}},
        2: {"messages": [{"role": "a@b.org", "content": []}]}, 3: {"options": {"a@b.org": 1}}, 4: {"options": {str(i): 0 for i in range(600)}}, 5: {"messages": [{"role": "user", "content": [{"type": "tool-call", "id": "a@b.org"}]}]},
    }
    rows = [(k, json.dumps(v), "s") for k, v in trees.items()] + [(6, "[1]", "s"), (7, None, "s"), (8, json.dumps({"options": "x" * (1 << 20)}), "s"), (9, '{"options":' + "[" * 70 + "]" * 70 + "}", "s")]
    got = {r.tree_id: r for r in tree.sanitize_trees(spark.createDataFrame(rows, "tree_id long, tree string, session string"), sanitize.sanitize).collect()}
    assert json.loads(got[1].tree) == {"system": [part("to ***.org")], "messages": [{"role": "user", "content": [part("***.org")]}], "tools": {}, "options": {"n": 1, "none": None}}
    assert [got[i].error for i in range(2, 10)] == ["structure_changed", "structure_changed", "tree_strings", "structure_changed", "tree_form", "tree_form", "tree_bytes", "tree_depth"] and all(got[i].tree is None for i in range(2, 10))


def test_explain_and_scrubbing(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (2, "my email a@b.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in sanitize.explain(df, context=policy.Context("unknown")).collect()}
    assert got[1].blocked and got[1].reasons[0].reason == "unknown_recipient_blocked" and got[1].reasons[0].used_default and "value" not in got[1].reasons[0].asDict()
    assert got[2].error == "kind_not_value_free" and got[2].reasons is None and got[3].error == "no_text"
    assert {r.doc_id: r.status for r in sanitize.explain(df, strict=False).collect()} == {1: "ok", 2: "ok", 3: "error"}
    plan = spark.createDataFrame([([("a",), ("abc",), ("",)],)], "plan array<struct<value:string>>")
    assert plan.select(validate.scrubbed(F.lit("abc is a"), F.col("plan")).alias("m")).first().m == "[redacted] is [redacted]"
    assert spark.range(1).select(transform.generalized(F.lit("no kind")).alias("g")).first().g is None


def test_gate_and_corpus(spark):
    schema = "id string, category string, text string, gate_modes array<string>, entities array<struct<kind:string,surface:string,start_char:int,end_char:int>>"
    rows = [("a", "c", "xé@b", ["regex"], [("k", "é@", 1, 3)]), ("b", "c", "xy", [], [("k", "y", 0, 1)]), ("c", "", "x", [], []), ("d", "c", "x", [], None), ("d", "c", "x", [], None), (None, "c", "x", [], [])]
    cases = spark.createDataFrame(rows, schema)
    assert {(r.id, r.error) for r in quality.corpus_errors(cases).collect()} == {("b", "surface"), ("c", "no_metadata"), ("d", "id_twice"), (None, "no_id")}
    span = "id string, kind string, start int, end int"
    truth, found = spark.createDataFrame([("a", "k", 1, 3), ("b", "k", 0, 1)], span), spark.createDataFrame([("a", "k", 1, 4)], span)
    assert [(r.id, r.wrong) for r in quality.gate(cases, truth, found, "regex").collect()] == [("a", 2)]


def rpc(i, tool, **a):
    return json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": tool, "arguments": a}})


def test_requests_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [rpc("1", "context.sanitize", text="to a@b.org", session="s"), "", "{bad", "[1]", rpc("2", "nope", text="x"), rpc("3", "context.restore", text="x"), rpc("4", "context.inspect", text="a@b.org"), json.dumps({"jsonrpc": "2.0", "method": "tools/call"})]
    (tmp_path / "in" / "1.txt").write_text("\n".join(lines))
    store, sink = VaultStore(spark, f"file://{tmp_path}/vault", KEY), audit.AuditSink(spark, f"file://{tmp_path}/audit")
    q = requests.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), store, KEY, str(tmp_path / "ck"), sink=sink)
    q.awaitTermination(240)
    assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.id, r.tool): r for r in out}
    assert got["1", "context.sanitize"].text.startswith("to __DO_PRIVATE_EMAIL_1_")
    assert sorted(r.status for r in out) == ["error -32600", "error -32602", "error -32602", "error -32700", "ok", "ok"]
    assert store.read().count() == 1 and [json.loads(r.event)["operation"] for r in sink.read().collect()] == ["sanitize"]


def test_requests_context_ids_and_order(spark, tmp_path):
    special = {"data_category": "special_category"}
    lines = [
        rpc("x", "context.sanitize", text="a@b.org", session="s"), rpc("x", "context.sanitize", text="a@b.org", session="t"), rpc(7, "context.sanitize", text="a@b.org", recipient="unknown", **special), rpc(8, "context.sanitize", text="a@b.org", recipient="trusted", jurisdiction="DE", **special),
        rpc(9, "context.sanitize", text="a@b.org", recipient="trusted", **special), rpc(10, "context.sanitize", text="a@b.org", recipient="nobody"), rpc(11, "context.sanitize", text="a@b.org", jurisdiction="DEU"), rpc(12, "context.sanitize", text="a@b.org", purpose=3), rpc(13, "context.sanitize", text="a", zap=1),
        rpc(14, "context.sanitize", text=5), rpc(None, "context.inspect", text="a"), rpc(15, "context.sanitize", text="a@b.org", recipient=None), rpc(16, "context.forget", session="s"), rpc(17, "context.sanitize", text="c@d.org", session="s"), rpc(18, "context.forget", session="u"), "x" * (requests.MAX_FRAME + 1),
    ]
    store = VaultStore(spark, f"file://{tmp_path}/vault")
    calls = lambda ls: requests.parse(spark.createDataFrame(list(enumerate(ls)), "n int, value string"), tools=requests.TOOLS, order=F.col("n"))
    got = {r.row: r for r in requests.answer(calls(lines), store, KEY, now=1).collect()}
    status = [got[i].status for i in range(len(lines))]
    assert status == ["ok", "ok", "blocked", "ok", "blocked", "tool error recipient", "tool error jurisdiction", "tool error purpose", "error -32602", "error -32602", "error -32600", "ok", "ok", "ok", "ok", "error -32600"]
    assert got[0].text != got[1].text and got[0].id == got[1].id == "x" and got[2].text is None
    assert got[13].text.startswith("__DO_PRIVATE_EMAIL_1_")  # counters start again after a forget
    assert {(r.scope, r.original) for r in store.read().collect()} == {("s", "c@d.org"), ("t", "a@b.org"), ("default", "a@b.org")}
    again = requests.answer(calls([rpc(1, "context.restore", text=got[0].text + got[13].text, session="s"), rpc(2, "context.sanitize", text="e@f.org c@d.org", session="s")]), store, KEY, now=2).collect()
    text = {r.id: r.text for r in again}
    assert text["1"] == got[0].text + "c@d.org" and text["2"].endswith(got[13].text) and "EMAIL_2_" in text["2"]
    assert requests.answer(calls([]), store, KEY, now=3).count() == 0


def test_settings_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('transformer = "mask"\nrecipient = "local"\n[policy_matrix]\norigin = "de"\nadequate = ["fr"]\n[[policy_matrix.rules]]\npurpose = "support"\naction = "redact"\nrecipients = ["external"]\n')
    s, origin = resolve(str(f), {"SPANVEIL_RECIPIENT": "trusted", "SPANVEIL_AUDIT_MAX_RECORDS": "5"}, judge="heuristics", tools="restore,forget")
    assert (s.transformer, s.recipient, s.judge, s.audit_max_records, origin["policy"]) == ("mask", "trusted", "heuristics", 5, "default") and tool_names(s) == ("context.restore", "context.forget")
    assert matrix(str(f)) == policy.Matrix("DE", ("FR",), True, (policy.Rule("support", "redact", ("external",)),))
    assert ("vault_path", "unset", "default") in report(s, origin) and ("recipient", "trusted", "environment") in report(s, origin)
    for bad in ({"recipient": "nobody"}, {"jurisdiction": "DEU"}, {"model_max_tokens": 8}, {"tools": "zap"}, {"process_timeout_ms": "x"}, {"detector": "gone"}):
        with pytest.raises(ValueError):
            resolve(None, {}, **bad)
    with pytest.raises(ValueError):
        resolve(str(f), {}, trusted=False)
    f.write_text("zap = 1\n")
    with pytest.raises(ValueError):
        resolve(str(f), {})


def test_process_vault_in_the_pipeline(spark, child, tmp_path):
    s = Settings(detector="process", vault="process", audit_path=f"file://{tmp_path}/a", detector_program=" ".join(child), vault_program=" ".join(child))
    p = engine.build(spark, s)
    df = spark.createDataFrame([(1, "a SEC b", "s"), (2, "none here", "s")], "doc_id long, text string, scope string")
    got = {r.doc_id: r for r in engine.run(p, df).collect()}
    assert (got[1].status, got[1].error) == ("error", "vault_round_trip") and got[2].clean_text == "none here"  # that child only knows kind k
    back = engine.restore(p, spark.createDataFrame([(1, "x __DO_PRIVATE_fine__ __DO_PRIVATE_lost__", "s")], df.schema)).first()
    assert (back.text, back.resolved) == ("x fine __DO_PRIVATE_lost__", 1)
    engine.forget(p, spark.createDataFrame([("s",)], "scope string"))
    with pytest.raises(plugins.PluginError):
        engine.forget(p, spark.createDataFrame([("t",)], "scope string"))


def test_counter_overflow_is_an_error(spark):
    wanted = spark.createDataFrame([("s", "email", "x@y.org", 1)], "scope string, kind string, original string, first int")
    top = spark.createDataFrame([("s", "email", 2**63 - 1)], "scope string, kind string, value long")
    with pytest.raises(Exception, match="OVERFLOW"):
        vault.mint(wanted, None, top, KEY)


def test_lifecycle_forgets_and_latches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    p = engine.build(spark, Settings(vault="store", vault_path=f"file://{tmp_path}/v"), key=KEY)
    engine.run(p, spark.createDataFrame([(1, "a@b.org", "s"), (2, "a@b.org", "t")], "doc_id long, text string, scope string")).collect()
    (tmp_path / "in" / "1").write_text('{"type":"session.deleted","sessionID":"s"}\n{broken\n{"type":"session.idle","sessionID":"t"}\n')
    life = lifecycle.Lifecycle(spark, p, f"file://{tmp_path}/latch")
    q = life.serve(str(tmp_path / "in"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None and [r.scope for r in p.store.read().collect()] == ["t"] and life.healthy()
    events = spark.createDataFrame([('{"type":"session.deleted","sessionID":"t"}',)], "value string")
    p.store.wait = 0.1
    with p.store.lock(), pytest.raises(lifecycle.Unhealthy):
        life.apply(events)
    with pytest.raises(lifecycle.Unhealthy):
        life.apply(events)
    life.clear()
    life.apply(events)
    assert p.store.read().count() == 0


def test_sidecar_and_sql_functions(spark):
    got = plugins.call([sys.executable, "-m", "spanveil.operators.sidecar"], {"method": "judge", "input": "x", "entities": [{"kind": "email", "value": "a@mail5.example.com"}, {"kind": "api_key", "value": "k"}, {"kind": "phone", "value": "1"}]})
    assert [j["label"] for j in plugins.check_judgments(3, got)] == ["test", None, "personal"]
    with pytest.raises(plugins.PluginError):
        plugins.call([sys.executable, "-m", "spanveil.operators.sidecar"], {"method": "plan"})
    sql.register(spark)
    r = spark.sql("SELECT spanveil_mask('a@b.org'), spanveil_generalize('email'), spanveil_generalize('a b'), spanveil_is_secret_kind('API_KEY'), spanveil_is_placeholder(spanveil_redacted()), spanveil_luhn_valid('4111-1111-1111-1112')").first()
    assert tuple(r) == ("***.org", "__DO_PRIVATE_EMAIL__", None, True, True, False)
