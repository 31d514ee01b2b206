import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions import vacancy as vc


@pytest.fixture(scope="module")
def value(spark):
    def value(column, *cells, schema=None):
        names = [f"c{i}" for i in range(len(cells))]
        rows = spark.createDataFrame([tuple(cells)], schema or ", ".join(f"{n} string" for n in names))
        return rows.select(column(*map(F.col, names)).alias("v")).first()["v"]

    return value


def test_list_cells(value):
    cases = {"['A', \"b\"]": ["a", "b"], "a|b;c,A": ["a", "b", "c"], " nan ": [], "": [], None: [], "[x, Y|y]": ["x", "y"], "\tSQL\t": ["sql"]}
    for cell, expected in cases.items():
        assert value(tx.list_cell, cell) == expected, cell
    assert value(tx.runtime_list_cell, "[a b]") == ["a", "b"] and value(tx.runtime_list_cell, "a,nan") == ["a", "nan"]
    assert value(tx.runtime_list_cell, None) == [] and value(tx.runtime_list_cell, "NaN") == []


def test_skill_bag(value):
    def bag(phrase):
        return value(lambda c: tx.skill_bag(F.array(c)), phrase)

    assert bag("git/github") == ["git", "git github", "git/github", "github"]
    assert {"object-oriented design", "object oriented design", "object oriented", "oriented design", "design"} <= set(bag("Object-oriented design"))
    assert bag("https://x.y/z") == [] and bag(None) == []
    long = bag("built the node.js services with great care")
    assert "node.js" in long and "great care" in long and "the node.js" not in long and not any(len(t.split()) > 2 for t in long)


def test_tokens(value):
    assert value(tx.title_tokens, "Sr. C++/C# Engineer II of a Team") == ["c++", "c#", "engineer", "team"]
    assert value(tx.token_set, "Front-end/Back-end  dev") == ["front", "end", "back", "dev"] and value(tx.token_set, None) == []
    assert value(tx.piped_skills, "SQL||sql|SQL") == ["SQL", "sql"] and value(tx.literal_skills, "['a', 'b']") == ["a", "b"] and value(tx.literal_skills, "a, b") == []
    assert value(tx.number_or, "x") == 0.0 and value(tx.number_or, "2.5") == 2.5


def test_segments_and_previews(value):
    assert value(tx.dedup_segments, "A  a   B") == "A   B" and value(tx.dedup_segments, "one segment") == "one segment"
    assert value(tx.dedup_segments, "  ") == "  " and value(tx.dedup_segments, None) is None
    assert value(lambda c: tx.preview(c, 5), "abcdefg") == "abcde..." and value(lambda c: tx.preview(c, 5), " ab ") == "ab"
    assert value(lambda c: tx.snippet(c, 4), "a  b\ncd") == "a b…"
    assert value(tx.percent, 0.745, schema="c0 double") == 75 and value(tx.percent, None, schema="c0 double") == 0


def test_vacancy_years(value):
    text = "5+ years of this, 3 yrs of that, 99 years ago"
    assert value(vc.vacancy_years, text) == 3 and value(vc.request_years, text) == 5
    assert value(vc.vacancy_years, "5 лет опыта") == 5 and value(vc.vacancy_years, "none") is None and value(vc.request_years, "none") == 0


def test_vacancy_title_and_skills(value):
    assert value(vc.vacancy_title, "About\nPosition: Data Engineer\n") == "Data Engineer" and value(vc.vacancy_title, "overview\n- x\nBackend dev") == "Backend dev"
    assert value(vc.vacancy_title, "Вакансия: Аналитик") == "Аналитик" and value(vc.vacancy_title, "") == ""
    text = "Требования:\n• SQL, Go or Rust\nkubernetes\n\nignored, line\nWe use docker and Pandas. Benefits:\nwith friends"
    assert value(vc.vacancy_skills, text) == ["docker", "go", "kubernetes", "pandas", "rust", "sql"]
    assert value(vc.vacancy_skills, "nothing here") == [] and value(vc.vacancy_skills, None) == []


def test_unit_vectors_equal_their_sql_to_the_sign_of_zero(spark, tmp_path):
    import duckdb

    from matchloom.plans import texts

    odd = [[3.0, -4.0], [1.0, -1e-7], [-0.0, 2.0], [0.0, 0.0], [3.0, None, 4.0], [None, 0.0], [None], [], None, [float("nan"), 1.0], [float("inf"), -1.0], [0.75, -0.015625, 0.1]]
    rows = spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    wanted = {k: repr(v) for k, v in con.execute(texts.ORACLES["unit_vectors"]).fetchall()}
    assert {r.vec_id: repr(r.v) for r in texts.unit_vectors(spark, str(tmp_path)).collect()} == wanted
