import hashlib
import random
import re

from chunkloom.llm import op3_pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


def texts():
    rng = random.Random(4)
    parts = ["a@b.co", "x_y.z@", "@", "a.b", ".", "-", " ", "+", "1", "4111 1111 1111 1111", "4111-1111-1111-1112", "255.0.0.1", "256.1.1.1", "0001.2.3.004.5", "+1 (555) 123-4567", "+12", "é", "😀", "\n", "(", ")", "_", "%"]
    return [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)), " ".join(f"u{i}@h{i}.org 10.0.0.{i % 300}" for i in range(900))]


def test_base_spans_equal_python(spark):
    found = texts()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for r in op3_pii.personal_data(docs).collect():
        got = ",".join(f"{x.kind}:{x.s}:{x.e}" for x in r.spans if x.kind != op3_pii.ADDED)
        assert got == base(found[r.doc_id]), found[r.doc_id]


def test_query_digest(spark, sf):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_pii.op3_pii(spark, sf).collect():
        text = base(source[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [text.count(f"{k}:") for k in PATTERNS]
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    """Seeds in one context teach it; another identifier there is found, the same shape elsewhere is not."""
    rows = [(i, f"Please write to user{i}@mail.org about it.") for i in range(12)]
    rows += [(100, "Please write to ABC-99812X about it."), (101, "Order number ABC-99812X arrived.")] + [(200 + i, f"Order number QQ{i}77812 arrived.") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(x.s, x.e, x.kind) for x in r.spans] for r in op3_pii.personal_data(docs).collect()}
    assert spans[100] == [(16, 26, "id")] and spans[101] == [] and spans[205] == []
    assert spans[3] == [(16, 30, "email")]
    kept = {r.doc_id: r.text for r in op3_pii.redact(docs).collect()}
    assert kept[100] == "Please write to [ID] about it." and kept[3] == "Please write to [EMAIL] about it." and kept[101] == rows[13][1]
    assert {r.doc_id: r.text for r in op3_pii.redact(docs, broadcast_entries=0).collect()} == kept


def contexts(before, after):
    """The three patterns of an instance, from the text on both sides up to its neighbours of the kind."""
    import regex

    left, right = regex.findall(r"[\p{L}=:]+", before), regex.findall(r"[\p{L}=:]+", after)
    two, one = ["^", "^", *(w.lower() for w in left)][-2:]
    return [f"{two} {one} _", f"{one} _", f"{one} _ {right[0].lower() if right else '$'}"]


def brute(docs, rounds=3, confidence=0.6, seeds=5, smoothing=2.0):
    """All spans of each document, by dictionaries: the pattern-instance graph in plain Python."""
    from collections import Counter, defaultdict

    import regex

    found = {}
    for i, text in docs:
        text, own = text or "", []
        for kind, p in [*PATTERNS.items(), ("id", r"(?<!\S)[^\s0-9]*[0-9]\S*")]:
            matches = list(re.finditer(p, text, re.A))
            for k, m in enumerate(matches):
                around = contexts(text[matches[k - 1].end() if k else 0 : m.start()], text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)])
                s, value = m.start(), m[0]
                if kind == "id":
                    inner = regex.sub(r"^[^\p{L}0-9+]+", "", value)
                    s, value = s + len(value) - len(inner), regex.sub(r"[^\p{L}0-9]+$", "", inner)
                    if len(value) < 6 or any(a < s + len(value) and s < b for b_kind, a, b, _, _ in own if b_kind != "id"):
                        continue
                elif not valid(kind, value):
                    continue
                own.append((kind, s, s + len(value), value, around))
        found[i] = own
    edges = Counter((p, f"{kind}:{value}", kind != "id") for own in found.values() for kind, _, _, value, around in own for p in around)
    trust = {instance: float(seed) for _, instance, seed in edges}
    for k in range(rounds):
        weight, good, seen = Counter(), Counter(), Counter()
        for (p, instance, seed), n in edges.items():
            weight[p] += n
            good[p] += n * trust[instance]
            seen[p] += seed
        sure = {p: good[p] / (weight[p] + smoothing) for p in weight}
        total, mean, seeded = Counter(), defaultdict(float), set()
        for (p, instance, seed), n in edges.items():
            total[instance] += n
            mean[instance] += n * sure[p]
            if seed:
                seeded.add(instance)
        trust = {x: 1.0 if x in seeded else mean[x] / total[x] for x in total}
    trusted = {p for p in sure if sure[p] >= confidence and seen[p] >= seeds}
    order = [*PATTERNS, "id"]
    return {i: [(kind, s, e) for s, _, e, kind in sorted((s, order.index(kind), e, kind) for kind, s, e, _, around in own if kind != "id" or trusted & set(around))] for i, own in found.items()}


def test_added_spans_equal_a_graph_of_dictionaries(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    names = ["account", "ref", "licence"]
    rows += [(10_000 + i, f"{'x' * (i % 3)} Write to user{i % 40}@mail.org now. {'Lang ' * (i % 30)}{names[i % 3]} no: 4111111111111111 or ZX-{i % 17}4477 end") for i in range(120)]
    rows += [(20_000 + i, f"{'é' * 100}{names[i % 3]} {'. ' * 100} no: AB{i}99-31 or {i}") for i in range(30)]
    rows += [(30_000 + i, f"Write to {'. ' * 60}K{i}-7731 now. {names[i % 3]} 2024-{i:04d} Write to (Q{i % 4}5566Z), end") for i in range(40)]
    expected = brute(rows)
    assert sum(kind == "id" for own in expected.values() for kind, _, _ in own) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in op3_pii.personal_data(docs).collect():
        assert [(x.kind, x.s, x.e) for x in r.spans] == expected[r.doc_id], r.doc_id


def test_added_spans_find_what_was_planted(spark):
    """Precision and recall of added spans where contexts say something: half of the numbers are customers', half are dates and sizes."""
    import random

    rng = random.Random(8)
    seeds = [f"Contact the customer at user{i}@mail.org today." for i in range(30)] + [f"Customer phone: +49 30 1234{i:03d}9 in the file." for i in range(30)]
    planted = [rng.choice([f"Contact the customer at CU-{i:04d}77 today.", f"Customer phone: 030/99{i:04d} in the file."]) for i in range(100)]
    clean = [rng.choice([f"The year 2024{i:03d} was long.", f"Size about {i:03d}450mm in total.", f"Order number Q{i:05d} arrived."]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(seeds + planted + clean)), "doc_id long, text string")
    added = {r.doc_id for r in op3_pii.personal_data(docs).collect() if any(x.kind == "id" for x in r.spans)}
    truth = set(range(len(seeds), len(seeds) + len(planted)))
    assert len(added & truth) / len(truth) >= 0.95 and len(added & truth) / max(1, len(added)) >= 0.95


def test_long_lists_of_matches(spark):
    """Positions of thousands of matches, beyond the blocks of the prefix sums, and contexts beyond 80 characters."""
    text = " ".join(f"n{i}@h.org" for i in range(3000))
    far = "customer address " + "- " * 200 + "a@b.org"
    rows = spark.createDataFrame([(1, text), (2, far)], "doc_id long, text string")
    found = {r.doc_id: r for r in op3_pii.scan(rows).collect()}
    assert [(x.s, x.e) for x in found[1].email] == [m.span() for m in re.finditer(PATTERNS["email"], text)]
    assert found[2].email[0].patterns == ["customer address _", "address _", "address _ $"]


def test_native_plan(spark, sf):
    plan = op3_pii.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
