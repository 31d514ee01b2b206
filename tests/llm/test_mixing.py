import hashlib

from matchloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def docs(spark):
    rows = [(i, "word " * (i % 37), ["en", "de", "fr", None][i % 4], f"src{i % 7}" if i % 11 else None, "x") for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA)


def water(budget, caps, weights):
    """Shares by raising the level until the budget is spent: children in order of cap / weight."""
    names = sorted(caps, key=lambda k: (caps[k] / weights[k], k))
    share, left = {}, budget
    while names and (left * weights[names[0]] >= caps[names[0]] * sum(weights[n] for n in names)):
        share[names[0]] = caps[names[0]]
        left -= caps[names.pop(0)]
    total, before = sum(weights[n] for n in names), 0
    for n in sorted(names):
        share[n] = left * (before + weights[n]) // total - left * before // total
        before += weights[n]
    return share


def test_selection_equals_brute_force(spark):
    rows = [(r.doc_id, len((r.text or "").encode()) + 3 >> 2, r.lang or "", r.source or "", r.source) for r in docs(spark).collect()]

    def domain(source):
        return mixing.DOMAINS[int(source[3:]) % 4] if source else "other"

    held = {}
    for _, tokens, lang, leaf, source in rows:
        held[domain(source), lang, leaf] = held.get((domain(source), lang, leaf), 0) + tokens
    caps = {k: v * mixing.EPOCHS for k, v in held.items() if v}
    total = sum(held.values()) * mixing.BUDGET_PERCENT // 100
    by_domain = {}
    for k, c in caps.items():
        by_domain[k[0]] = by_domain.get(k[0], 0) + c
    budget = {}
    for d, b in water(total, by_domain, {d: mixing.DOMAIN_WEIGHTS.get(d, mixing.OTHER_WEIGHT) for d in by_domain}).items():
        langs = {}
        for k, c in caps.items():
            if k[0] == d:
                langs[k[1]] = langs.get(k[1], 0) + c
        for lang, bl in water(b, langs, {x: mixing.LANGUAGE_WEIGHTS.get(x, mixing.OTHER_WEIGHT) for x in langs}).items():
            leaves = {k[2]: c for k, c in caps.items() if k[:2] == (d, lang)}
            for leaf, share in water(bl, leaves, dict.fromkeys(leaves, 1)).items():
                budget[d, lang, leaf] = share
    assert sum(budget.values()) == min(total, sum(caps.values()))
    expected = set()
    for key, b in budget.items():
        for epoch in range(mixing.EPOCHS):
            own = sorted((hashlib.md5(f"{mixing.SEED}|{epoch}|{i}".encode()).hexdigest(), i, t) for i, t, lang, leaf, source in rows if (domain(source), lang, leaf) == key)
            end = epoch * held[key]
            for _, i, t in own:
                end += t
                if end <= b and epoch * held[key] < b:
                    expected.add((i, epoch, end))
    got = {(r.doc_id, r.epoch, r.end_token) for r in mixing.select_prefixes(docs(spark)).collect()}
    assert got == expected


def test_documents_of_one_epoch_keep_their_columns(spark):
    chosen = {r.doc_id for r in mixing.select_prefixes(docs(spark), epochs=1, budget_percent=50).collect()}
    out = mixing.mix_documents(docs(spark), budget_percent=50)
    assert out.columns == docs(spark).columns
    assert {r.doc_id for r in out.collect()} == chosen


def test_empty_and_repeats(spark):
    assert mixing.select_prefixes(docs(spark).limit(0)).count() == 0
    twice = docs(spark).limit(20).unionByName(docs(spark).limit(20))
    assert mixing.select_prefixes(twice, budget_percent=100, epochs=1).count() == 38  # document 0, twice, is a leaf without tokens
    assert mixing.mix_documents(docs(spark), budget_percent=100).count() == 400


def test_clashing_names_and_long_texts(spark):
    clash = "domain string, language string, epoch int, tokens int, budget string, _row string, _cut string, _domain string"
    rows = [(i, "word " * (200_000 if i == 3 else i), "en", f"src{i % 3}", *["x", "y", 1, 2, "z", "r", "c", "d"]) for i in range(30)]
    table = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {clash}")
    plain = table.select("doc_id", "text", "lang", "source")
    assert sorted(map(tuple, mixing.select_prefixes(table).collect())) == sorted(map(tuple, mixing.select_prefixes(plain).collect()))
    out = mixing.mix_documents(table, budget_percent=70)
    assert out.columns == table.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in mixing.mix_documents(plain, budget_percent=70).collect()}


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None if i % 2 else i, f"text {i} of ten bytes or more", "en", "src1", "x") for i in range(400)]
    chosen = mixing.select_prefixes(spark.createDataFrame(rows, SCHEMA), epochs=1, budget_percent=50).collect()
    without = sum(r.doc_id is None for r in chosen)
    assert 60 <= without <= 140 and 180 <= len(chosen) <= 220
    copies = spark.createDataFrame([(None, t, "en", "src1", "x") for t in ["same text here"] * 30 + [None] * 5 + [f"other text {i:02}" for i in range(30)]], SCHEMA)
    out = [r.text for r in mixing.mix_documents(copies, budget_percent=60).collect()]
    assert out.count("same text here") in (0, 30) and out.count(None) in (0, 5) and any("other" in t for t in out if t)
