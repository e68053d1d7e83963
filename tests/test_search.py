"""Lexicon, searches, evaluation, tables and SQL functions on small cases, against plain Python where there is one."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import lexicon, vocab
from quillon.functions import text as T
from quillon.functions.casualties import casualties, casualties_of
from quillon.functions.embedding import embed
from quillon.functions.organisations import is_city, is_fragment, is_name, is_venue, organisations, organisations_of
from quillon.operators import evaluation, incidents, retrieval, search
from quillon.plans import registry, sql
from quillon.sources import datasets, files, tables
from quillon.streaming import events as stream

SF = "/root/testdata/sf0.001"


def _texts(seed, n=300):
    r = random.Random(seed)
    terms = [t for v in (vocab.ATTACK, vocab.WEAPON, vocab.TARGET) for terms in v.values() for t in terms] + [t for _, terms in vocab.EVENT_TERMS + vocab.ADMIN_TERMS for t in terms]
    glue = ["", " ", " ", " ", "-", "s ", ". ", " offset ", "X", "é", " FIR ", " fir ", "IPC", "_", "\n"]
    return ["".join(r.choice([r.choice(terms), r.choice(terms).upper(), "word"]) + r.choice(glue) for _ in range(r.randint(0, 9))) for _ in range(n)] + [None, ""]


def test_lexicon_finds_what_single_patterns_find(spark):
    texts = _texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", T.detect(F.col("t")).alias("d"), T.attack_types(F.col("t")).alias("a"), incidents.terms(F.col("t")).alias("all")).collect()

    def there(text, term):
        low = text.lower()
        return bool(re.search(rf"\b{re.escape(term)}\b", low)) if " " not in term else term in low

    for row in found:
        t = texts[row.i] or ""
        count = lambda terms, t=t: sum(there(t, x) for x in dict.fromkeys(terms))
        event = sum(w * count(terms) for w, terms in vocab.EVENT_TERMS)
        event += vocab.CORE_BONUS * count(vocab.CORE_VERBS) if event else 0
        admin = sum(w * count(terms) for w, terms in vocab.ADMIN_TERMS) + vocab.ADMIN_CASED[0] * sum(bool(re.search(rf"\b{x}\b", t)) for x in vocab.ADMIN_CASED[1])
        assert (row.d.event_score, row.d.admin_score) == (event, admin), t
        for vocabulary, got in ((vocab.ATTACK, row.a), (vocab.ATTACK, row.all.attack_types), (vocab.WEAPON, row.all.weapon_types), (vocab.TARGET, row.all.target_types)):
            assert got == [c for c, terms in vocabulary.items() if any(there(t, x) for x in terms)]
        alone = lambda terms, t=t: any(re.search(rf"\b{re.escape(x)}\b", t.lower()) for x in terms)
        assert row.all.anchor == alone(T.ANCHORS) and row.all.attack == alone(vocab.ATTACK_ANCHORS) and row.all.operation == alone(vocab.OPERATION_ANCHORS)
        assert row.all.boundary == any(x in t.lower() for x in vocab.BOUNDARIES) and row.all["class"] == row.d["class"]


def test_lexicon_layers():
    assert lexicon.layers(["machine", "machine gun", "machines"], True) == [["machine gun", "machines"], ["machine"]]
    assert re.fullmatch(lexicon.prefix_pattern(["bomb", "bombing", "blast", "a.b"]), "bombing") and not re.fullmatch(lexicon.prefix_pattern(["a.b"]), "axb")


def test_triggers_and_predicates(spark):
    df = spark.createDataFrame([("Gunmen attacked a camp; 5 soldiers were killed.",), ("FIR filed, charge sheet and bail",), (None,)], "t string")
    a, b, c = [r.x for r in df.select(T.detect_with_triggers(F.col("t")).alias("x")).collect()]
    assert a.is_event and {"attacked", "killed", "camp", "soldiers"} <= set(a.event_triggers) and a.admin_triggers == []
    assert b.is_admin and {"charge sheet", "bail", "FIR"} <= set(b.admin_triggers) and c.is_neutral


def test_text_filters_lose_nothing(spark):
    r = random.Random(3)
    parts = ["killed", "5", "five", "dozens", "in addition to the attacker", "died", "gunman", "were injured", "people", "claimed 3 lives", "Taliban", "LeT", "let", "carried out by Group", "the", "CRPF", "personnel were killed", "Red Cross", "convoy of Ranger,"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", casualties(F.col("t")).alias("c"), organisations(F.col("t")).alias("o"))
    for row in df.collect():
        assert tuple(row.c) == (casualties_of(row.t) if row.t else (0, 0)) and (row.o.groups, row.o.targets) == (organisations_of(row.t) if row.t else ([], []))


def test_what_is_no_name():
    assert is_venue("Taj Hotel") and is_venue("airport security") and not is_venue("Taliban")
    assert is_city("Mumbai") and is_city("Delhi Police") and not is_city("Jammu and Kashmir Police force") and not is_city("Taliban")
    assert is_fragment("stormed the gate") and is_fragment("lower case") and not is_fragment("abc") and not is_fragment("Boko Haram")
    assert is_name("Boko Haram") and not any(map(is_name, ("No", "civilians", "Airport Security Force", "Mumbai", "killed by Rebels")))


def test_sentences_and_lists_keep_their_ends(spark):
    df = spark.createDataFrame([("10 men came in 2010. Then 20 left at 11.", " a1 ,, 0b0 ")], "t string, c string")
    row = df.select(T.sentences(F.col("t")).alias("s"), T.csv_decode(F.col("c")).alias("c")).first()
    assert row.s == ["10 men came in 2010.", "Then 20 left at 11."] and row.c == ["a1", "0b0"]


def test_bad_numbers_are_zero(spark):
    df = spark.createDataFrame([(x,) for x in ("1e20", "NaN", "inf", "-inf", "3.9", "", None, "2147483648")], "x string")
    assert [tuple(r) for r in df.select(T.parse_int(F.col("x")), T.parse_casualty(F.col("x"))).collect()] == [(0, None), (0, None), (0, None), (0, None), (3, 3), (0, None), (0, None), (0, None)]


def test_nearest_in_any_blocks(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(200)] + [(500, [0.0] * 6), (501, None), (0, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0 and vec_id < 200").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = sorted(map(tuple, retrieval.nearest(df, asked.where("query_id > 0"), 5).collect()))
    parts = sorted(map(tuple, retrieval.nearest(df, asked.where("query_id > 0"), 5, shard=37, block=3).collect()))
    norm = lambda v: sum(x * x for x in v) ** 0.5
    vector = {i: v for i, v in rows[:200]}
    for q in range(20, 200, 20):
        near = sorted((-round(sum(a * b for a, b in zip(vector[q], v, strict=True)) / norm(vector[q]) / norm(v), 6), i) for i, v in rows[:200] + rows[202:] if i != q)[:5]
        assert [(x[1], x[2]) for x in whole if x[0] == q and x[3] <= 5] == [(i, -s) for s, i in sorted(near, key=lambda x: x[1])] or sorted((x[3], x[1]) for x in whole if x[0] == q) == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert whole == parts and 500 not in {x[1] for x in whole}


def _table(spark):
    lists = {c: [] for c in ("attack_types", "target_types", "weapon_types", "responsible_groups")}
    rows = [
        {"incident_id": "a", "date": "2008-11-26", "country": "India", "state": "Maharashtra", "city": "Mumbai", "killed": 10, "injured": 2, "summary": "Gunmen attacked a hotel in Mumbai.", "has_summary": True} | lists | {"attack_types": ["Armed Assault"]},
        {"incident_id": "b", "date": "2010-01-01", "country": "India", "state": "Maharashtra", "city": "Pune", "killed": 1, "injured": 0, "summary": "A bomb went off in a bakery.", "has_summary": True} | lists | {"attack_types": ["Bombing/Explosion"], "responsible_groups": ["Indian Mujahideen"]},
        {"incident_id": "c", "date": "", "country": "", "state": "", "city": "", "killed": 0, "injured": 0, "summary": "Nothing of note at the Embassy.", "has_summary": True} | lists,
    ]
    schema = "incident_id string, date string, country string, state string, city string, killed int, injured int, summary string, has_summary boolean, attack_types array<string>, target_types array<string>, weapon_types array<string>, responsible_groups array<string>"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    return df.withColumn("retrieval_text", T.retrieval_text({c: F.col(c) for c in df.columns}))


def test_search_and_answers(spark):
    table = _table(spark).withColumn("document", F.col("retrieval_text")).withColumn("embedding", embed(F.col("retrieval_text")))
    asked = spark.createDataFrame([(1, "Bombings in Pune in 2010"), (2, "  "), (3, "What happened near the embassy?"), (4, "most common attacks"), (5, None)], "id int, question string")
    found = search.search(table, asked, 3, None).collect()
    assert {r.id for r in found} == {1, 3, 4}
    first = {r.id: r.incident_id for r in found if r["rank"] == 1}
    assert first[1] == "b" and first[3] == "c"
    best = next(r for r in found if r.id == 1 and r.incident_id == "b")
    other = next(r for r in found if r.id == 1 and r.incident_id == "a")
    assert best.score > 1.0 and other.score < 0.2  # the asked attack type, year and place
    answers = {r.id: r.answer for r in search.answers(table, asked).collect()}
    assert answers[4] == search.REFUSAL and answers[2] == search.NOTHING and "bakery" in answers[1]
    said = {r.id: r.answer for r in search.answers(table, asked, generate=lambda prompt, system: F.concat(F.substring(system, 1, 10), F.lit(". cut"))).collect()}
    assert said[1] == "You are a ."
    pictures = spark.createDataFrame([("p", "embassy.png", "", "door")], "asset_id string, filename string, ocr_text string, caption string").withColumn("embedding", embed(F.lit("embassy")))
    with_pictures = search.search(table, asked, 5, None, pictures=pictures).where("id = 3 and asset_id = 'p'").collect()
    assert len(with_pictures) == 1
    mine = search.search_uploaded(table, asked).collect()
    assert all(r.score > 0.25 for r in mine) and {r.id for r in mine} <= {1, 3, 4}


def test_clause_of_columns_and_of_blocks_agree(spark):
    """The where clause as an expression and over a shard's arrays, on the same incidents and questions."""
    table = _table(spark).withColumn("weapon_types", F.when(F.col("incident_id") == "a", F.array(F.lit("Firearms"))).otherwise(F.array().cast("array<string>")))
    texts = ["Bombings in Pune", "gun attacks in Mumbai", "Maharashtra", "IM attacks", "anything", "kashmir", "armed assault with a rifle in mumbai"]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, question string").withColumn("filters", search.question_filters(F.col("question")))
    pairs = asked.crossJoin(table).select("id", search.where_clause(F.col("filters"), {c: F.col(c) for c in table.columns}).alias("fits"))
    want = {r.id: r.n for r in pairs.where("fits is not null").groupBy("id").agg(F.count_if("fits").alias("n")).collect()}
    for shard, block in ((1 << 15, 1 << 10), (1, 2)):
        assert {r.query_id: r.n for r in search.matching(table, asked, shard, block).collect()} == want
    assert want[0] == 1 and want[1] == 1 and want[2] == 2 and want[3] == 1 and 4 not in want and want[5] == 0


def test_same_words_are_sought_once_and_answer_all(spark):
    """Questions of few texts: every one has its rows, each text is embedded once, and many texts give the same."""
    table = _table(spark).withColumn("document", F.col("retrieval_text")).withColumn("embedding", embed(F.col("retrieval_text")))
    texts = ["Bombings in Pune in 2010", "What happened near the embassy?", " ", None]
    asked = spark.createDataFrame([(i, texts[i % 4]) for i in range(2400)], "id int, question string")
    met = spark.sparkContext.accumulator(0)

    def embedder(text):
        @F.arrow_udf("string")
        def count(batch: pa.Array) -> pa.Array:
            met.add(len(batch))
            return batch

        return embed(count(text))

    one = {(r.id, r.incident_id, r["rank"], r.score) for r in search.search(table, asked.where("id < 4"), 3, None).collect()}
    found = search.search(table, asked, 3, None, embedder).collect()
    assert len(found) == 600 * len(one) and {(r.id % 4, r.incident_id, r["rank"], r.score) for r in found} == one
    assert met.value <= 20  # two texts, a few times
    said = search.answers(table, asked).groupBy("answer").count().collect()
    assert sorted(r["count"] for r in said) == [600, 600, 1200]
    near = {(r.id % 4, r.incident_id, r.score) for r in search.search_uploaded(table, asked).collect()}
    assert near == {(r.id, r.incident_id, r.score) for r in search.search_uploaded(table, asked.where("id < 4")).collect()}


def test_blocks_of_questions_and_one_table_of_them_agree(spark):
    table = _table(spark).withColumn("document", F.col("retrieval_text")).withColumn("embedding", embed(F.col("retrieval_text")))
    table = table.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("incident_id", F.concat("incident_id", F.col("copy").cast("string")))
    texts = ["Bombings in Pune", "gun attacks in Mumbai", "the embassy", "anything", "IM attacks at the airport hotel"]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, question string").withColumn("filters", search.question_filters(F.col("question"))).withColumn("q", embed(F.col("question")))
    some = [sorted(map(tuple, search.candidates(table, asked, 7, 3, shard, block).collect())) for shard, block in ((1 << 15, 1 << 10), (9, 1 << 10), (9, 2))]
    assert some[0] == some[1] == some[2] and {x[0] for x in some[0]} == set(range(5))


def test_best_rows_of_tables():
    rows = [(q, w, s, v) for q in ("a", "b") for w in ("x", "y") for s, v in ((0.5, "2"), (0.5, "1"), (0.9, "3"), (0.1, "0"))]
    t = pa.table(dict(zip(("query_id", "way", "score", "vec_id"), map(list, zip(*rows, strict=True)), strict=True)))
    assert [(r["query_id"], r["way"], r["vec_id"]) for r in retrieval.best_of(2, "way")(t).to_pylist()] == [(q, w, v) for q in ("a", "b") for w in ("x", "y") for v in ("3", "1")]
    assert retrieval.best_of(2)(t).num_rows == 4 and retrieval.best_of(2)(t.slice(0, 0)).num_rows == 0


def test_vectors_of_a_column():
    made = retrieval.matrix(pa.chunked_array([pa.array([[3.0, 4.0], None], pa.list_(pa.float64())), pa.array([[0.0, 2.0], [1.0], [None, 1.0], [], [0.0, 0.0]], pa.list_(pa.float64()))]))
    assert made.tolist() == [[0.6, 0.8], [0, 0], [0, 1.0], [0, 0], [0, 0], [0, 0], [0, 0]]


#: Queries whose questions are a few texts, asked by many.
_ASKED = ["qf_where", "r_image", "r_search", "r_unfiltered_diff", "g_rag", "r_mem", "r_sort_topk"]


@pytest.mark.parametrize("name", _ASKED)
def test_incidents_are_not_shuffled_for_a_few_texts(spark, name):
    """Incidents used to travel once for each block of questions, with their vectors."""
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan
    test_oracle(spark, name)


def test_set_score_is_greedy_and_one_to_one(spark):
    def plain(expected, actual):
        e, a = ([(x or "").strip().lower() for x in v or []] for v in (expected, actual))
        if not e and not a:
            return (1.0, 1.0, 1.0, 0, 0, 0)
        used = []
        for x in e:
            hit = next((i for i, y in enumerate(a) if i not in used and (x in y or y in x)), None)
            if hit is not None:
                used.append(hit)
        tp, fp, fn = len(used), len(a) - len(used), len(e) - len(used)
        p, r = tp / (tp + fp) if a else 0.0, tp / (tp + fn) if e else 0.0
        return (p, r, 2 * p * r / (p + r) if p + r else 0.0, tp, fp, fn)

    r = random.Random(9)
    items = ["Taliban", "the taliban", " ISIS", "ISIS-K", "is", "", "CRPF", "crpf men"]
    rows = [(i, *([r.choice(items) for _ in range(r.randint(0, 4))] for _ in range(2))) for i in range(300)] + [(900, None, ["a"]), (901, None, None)]
    df = spark.createDataFrame(rows, "i int, e array<string>, a array<string>")
    for x in df.select("i", evaluation.set_score(F.col("e"), F.col("a")).alias("s")).collect():
        _, e, a = next(v for v in rows if v[0] == x.i)
        assert tuple(x.s) == pytest.approx(plain(e, a))


def test_clusters_of_known_documents(spark):
    texts = [
        ("Militants attacked a convoy in Pulwama. 3 killed.", 1),
        ("A suicide bomber attacked a mosque. The blast was massive. At least 40 worshippers were killed. ISIS claimed responsibility.", 1),
        ("Officials met in Delhi on Monday and had tea.", 0),
    ]
    truth = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "doc_id long, text string, expected int")
    counts = evaluation.incident_counts(truth, incidents.build(truth.select("doc_id", "text")))
    row = evaluation.cluster_counts(counts).first()
    assert (row.documents, row.accuracy, row.false_splits, row.false_merges) == (3, 100.0, 0, 0)


def test_built_incidents_have_their_text(spark):
    docs = spark.createDataFrame([("x", "A bomb exploded in Pune on 3 May 2019 and 3 people were killed.")], "doc_id string, text string")
    (row,) = incidents.build(docs).collect()
    assert row.incident_id == "x-0" and row.has_summary and row.retrieval_text.startswith("Date: 2019-05-03\nLocation: Pune, Maharashtra, India\nAttack Type: Bombing\n") and "\n\nSummary:\nA bomb" in row.retrieval_text
    sql.register(spark)
    sql.sentences(docs).createOrReplaceTempView("sentences")
    (same,) = spark.sql("SELECT * FROM incidents(TABLE(SELECT * FROM sentences) PARTITION BY doc_id ORDER BY seq)").collect()
    assert (same.incident_id, same.city, same.killed, same.attack_types) == (row.incident_id, row.city, row.killed, row.attack_types)
    got = spark.sql("SELECT extract_casualties('5 people were killed') AS c, extract_organizations('The Taliban claimed responsibility.') AS o, size(embed_text('a b')) AS n").first()
    assert (got.c.killed, got.o.groups, got.n) == (5, ["Taliban"], 256)


def test_tables_round_trip(spark, tmp_path):
    path, index = f"{tmp_path}/incidents", f"{tmp_path}/index"
    tables.create(spark, path)
    tables.create(spark, path)
    assert tables.read(spark, path).count() == 0
    tables.save(spark, _table(spark), path)
    tables.save(spark, _table(spark).where("incident_id = 'a'").withColumn("killed", F.lit(99)), path)
    rows = tables.read(spark, path)
    assert rows.count() == 3 and tables.by_id(rows, "a").first().killed == 99 and rows.columns == [c.split()[0] for c in tables.TABLE.split(", ")]
    assert {r.incident_id for r in tables.by_label(rows, "attack_types", "BOMB").collect()} == {"b"} and tables.by_date(rows, "2008-01-01", "2009-01-01").count() == 1
    for _ in range(2):
        tables.build_index(spark, _table(spark), index, embed)
    assert tables.get(spark, index).count() == 3 and tables.get(spark, index, "other").count() == 0
    assets = spark.createDataFrame([("p", "f.png", "words", None, "d", "t", [1.0], []), ("q", "g.png", None, None, "d", "t", None, [1.0])], "asset_id string, filename string, ocr_text string, caption string, source_document_id string, retrieval_text string, text_embedding array<double>, image_embedding array<double>")
    tables.add(spark, tables.picture_records(assets), index)
    kept = tables.get(spark, index)
    assert {(r.id, r.collection) for r in kept.where("metadata['asset_type'] = 'image'").collect()} == {("p", "incidents"), ("q", "incidents_images")}
    assert {(r.collection, r.n) for r in tables.counts(kept).collect()} == {("incidents", 4), ("incidents_images", 1), (None, 5)}
    back = kept.where(~tables.is_picture(F.col("metadata"))).select(*tables.incident_of(F.col("metadata")).values())
    assert {(r.incident_id, r.killed, tuple(r.attack_types)) for r in back.collect()} == {("a", 10, ("Armed Assault",)), ("b", 1, ("Bombing/Explosion",)), ("c", 0, ())}


def test_evaluation_files(spark, tmp_path):
    header = "summary,attacktype1_txt,weaptype1_txt,targtype1_txt,nkill,nwound,other\n"
    (tmp_path / "eval.csv").write_text(header + '"A bomb killed 3 people.",Bombing/Explosion,Explosives,Police,3,,x\n"Nothing, ""really"".",Unknown,Unknown,Unknown,,,\n')
    results = evaluation.coded_results(datasets.read_evaluation(spark, f"{tmp_path}/eval.csv")).cache()
    metrics = {r.field: r for r in evaluation.field_metrics(results).collect()}
    assert (metrics["attack_type"].accuracy_known, metrics["attack_type"].accuracy_all, metrics["killed"].known, metrics["target_type"].correct) == (100.0, 100.0, 1, 0)
    datasets.write_failures(evaluation.coded_failures(results), f"{tmp_path}/failures")
    assert [r.prediction for r in spark.read.csv(f"{tmp_path}/failures", header=True).collect()] == ["Civilian"]
    report = datasets.report(evaluation.field_metrics(results)).first().report
    assert "| attack_type | 100.0% | 100.0% | 1 | 1 |" in report and "Missed: 1" in report
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "incident_001.json").write_text('{"date": "2019-01-01",\n "killed": 3, "attack_types": ["Bombing"]}')
    (row,) = datasets.read_truth(spark, str(truth)).collect()
    assert (row.name, row.killed, row.city, row.attack_types) == ("incident_001", 3, "", ["Bombing"])
    csv = tmp_path / "coded.csv"
    csv.write_text(",".join(datasets.CSV_COLUMNS) + ",more\n" + '1,2008,11,0,India,X,Mumbai,Bombing/Explosion,Unknown,,Unknown,NaN,1e20,"Two ""bombs"".\nMore",z\n')
    (coded,) = datasets.coded_incidents(datasets.read_csv(spark, str(csv))).collect()
    assert (coded.date, coded.killed, coded.injured, coded.summary, coded.responsible_groups) == ("2008-11-01", 0, 0, 'Two "bombs".\nMore', [])


def test_files_are_read_once(spark):
    rows = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.txt", "Caf\xe9".encode("latin-1")), ("c.png", b"\x89PNG\r\n"), ("d", b"\0\1"), ("e.pdf", b"%PDF-long")], "path string, content binary")
    pages = F.array(F.struct(F.lit("words of a page").alias("text"), F.array(F.lit("seen"), F.lit(None).cast("string")).alias("images")), F.struct(F.lit(" ").alias("text"), F.array(F.lit("more"), F.lit("")).alias("images")))
    read = {"PDF": lambda c: F.when(c.isNotNull() & (F.length(c) > 7), files.pdf_text(pages)), "SCANNED_PDF": lambda c: F.when(c.isNotNull(), F.lit("scanned"))}
    df = files.ingest(rows, read)
    got = {r.title: (r.source_type, r.raw_text, r.error is None) for r in df.collect()}
    assert got["a.pdf"] == ("SCANNED_PDF", "scanned", True) and got["b.txt"] == ("TXT", "Caf\xe9", True) and got["c.png"][0] == "IMAGE" and not got["c.png"][2] and "d" not in got
    assert got["e.pdf"] == ("PDF", "words of a page\n--- Embedded Image 1 on Page 1 ---\nseen\n--- Embedded Image 1 on Page 2 ---\nmore", True)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    (picture,) = files.image_documents(rows, ocr=lambda c: F.array(F.lit("a"), F.lit("b"))).collect()
    assert (picture.raw_text, picture.detections, picture.caption, picture.image_embedding) == ("a b", 2, "", None)
    incidents_, assets = incidents.process(files.image_documents(rows, caption=lambda c: F.lit("a bomb exploded in Pune and killed 3.")))
    assert assets.first().retrieval_text == "Caption: a bomb exploded in Pune and killed 3." and incidents_.count() == 0


def test_files_as_they_arrive(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.txt").write_text("A bomb exploded in Pune and 3 people were killed.")
    (drop / "b.bin").write_bytes(b"\0\1")
    for _ in range(2):
        stream.append_to(stream.classified(stream.file_stream(spark, str(drop)).withColumnRenamed("raw_text", "text")), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
        (drop / "c.txt").write_text("The charge sheet names accused persons; hearing on bail.")
    got = {r.title: r["class"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a.txt": "ACCEPT", "c.txt": "REJECT"} and spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.parametrize("name", ["er_similarity", "er_cluster", "fx_location", "fx_orgs", "fx_date", "r_search", "r_mem", "ag_fieldmetrics", "ag_macro", "ag_failures", "qf_where", "snk_add_image", "g_prompt", "flagship", "er_build"])
def test_oracle(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_one_copy_of_the_text_in_the_plan(spark):
    plan = registry.queries()["flagship"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("others were injured") == 1
