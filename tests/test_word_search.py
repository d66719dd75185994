"""Words of whole texts: one search for all of them, and the same trajectories as word by word."""

import random

from pyspark.sql import functions as F

from matchloom.functions import periods, text as tx, vocab as V
from matchloom.functions.trajectory import with_trajectory
from matchloom.functions.wordsearch import BYTES, Words


def test_words_are_those_that_a_plain_search_finds():
    rng = random.Random(3)
    letters = "abé ñ"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(60)})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(2000)]
    texts += [None, "", "a" * (BYTES + 5), *words]
    assert Words(words).in_column(texts) == [[w for w in words if w in (t or "")] for t in texts]


def test_trajectories_search_whole_texts_once_and_find_the_same(spark):
    rng = random.Random(4)
    searched = [w for ws in [*V.DOMAIN_WORDS.values(), *V.SENIORITY_WORDS.values()] for w in ws] + V.MID_WORDS
    parts = searched + ["Senior Data Engineer", "Vice President of Data", "ſtaff engineer", "at Google", "worked at Apple", "CTO", "İntern", "lorem", "12 years of experience", "2019 - 2021", "Jan 2018 to\x1c now", "03/19 – 04/21", "٢٠١٩ - ٢٠٢٠", "in 2020."]
    texts = [None, ""] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "resume_id long, text string").withColumns({
        "skills": F.array().cast("array<string>"), "years_experience": F.lit(None).cast("double"), "target_role": F.lit(None).cast("string")})
    body = F.concat(F.lit(" "), tx.blank_if_null(F.col("text")))
    plan = with_trajectory(rows)
    both = plan.select("seniority", tx.seniority(body).alias("s"), "domain", tx.domain(body).alias("d"), "company_tier", tx.company_tier(F.col("text")).alias("t"))
    found = both.collect()
    assert len({r["seniority"] for r in found}) > 4 and len({r["domain"] for r in found}) > 4 and {r["company_tier"] for r in found} == {0, 1}
    assert all((r["seniority"], r["domain"], r["company_tier"]) == (r["s"], r["d"], r["t"]) for r in found)
    # word by word, each text would be read once for each of the hundred words of the domains
    assert "contains(" not in plan.select("domain")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_date_range_is_left_unread(spark):
    rng = random.Random(6)
    pieces = ["2019", "19", "٢٠١٩", " ", "\x1c", " ", "-", "–", "—", "to", "TO", "Present", "now", "Jan", "march", ".", "/", "3", "x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    sent = {r["id"]: len(r["roles"]) for r in rows.select("id", periods.dated_roles(F.col("text"))["roles"].alias("roles")).collect()}
    direct = {i: len(periods.dated_spans(t, periods.settings.reference_year)) for i, t in enumerate(texts)}
    assert sent == direct and sum(direct.values()) > 20
