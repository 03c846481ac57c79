"""API validation messages, batch = single, demo inputs."""

import json

from pyspark.sql import functions as F

from affinity.operators import api, browse, manifests, recommend
from affinity.plans import registry as R
from inputs import SMOKE


def _errors(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    return [r.error for r in api.validate_requests(df).orderBy("request_id").collect()]


def test_validation_messages(spark):
    got = _errors(spark, [
        "THIS IS NOT A JSON!",
        "{}",
        json.dumps({"language": "NOT SUPPORTED VALUE", "dependencies": ["lodash@4.17.15"]}),
        json.dumps({"language": None, "dependencies": ["lodash@4.17.15"]}),
        json.dumps({"language": "javascript", "dependencies": {}}),
        json.dumps({"language": "javascript", "dependencies": None}),
        json.dumps({"language": "Python", "dependencies": []}),
        json.dumps({"language": "Javascript", "dependencies": ["lodash@4.17.15", "react@16.13.1"]}),
    ])
    assert got[0].startswith("Could not parse JSON")
    assert got[1].startswith("Required JSON key")
    assert got[2].startswith("Language not supported")
    assert got[3].startswith("Error casting language to lower()")
    assert got[4].startswith("Javascript dependencies must be non-empty and of type LIST")
    assert got[5].startswith("Javascript dependencies must be non-empty and of type LIST")
    assert got[6].startswith("Python dependencies must be non-empty and of type LIST")
    assert got[7] is None


def test_api_lists_to_purls(spark):
    bodies = [json.dumps({"language": "Javascript", "dependencies": ["lodash@4.17.15", "@reach/router@1.3.1"]}),
              json.dumps({"language": "Python", "dependencies": ["Django==2.1.2", "requests>=2.23.0"]})]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    got = sorted((r.request_id, r.purl) for r in api.request_purls(api.validate_requests(df)).collect())
    assert got == [(0, "pkg:npm/@reach/router@1.3.1"), (0, "pkg:npm/lodash@4.17.15"),
                   (1, "pkg:pypi/Django@2.1.2"), (1, "pkg:pypi/requests@2.23.0")]


def test_demo_inputs_parse(spark):
    got = sorted(r.purl for r in manifests.parse_dependencies(browse.demo_requests(spark), from_repository=False)
                 .collect())
    assert got == sorted(["pkg:npm/lodash@4.17.15", "pkg:npm/react@16.13.1", "pkg:npm/express@4.17.1",
                          "pkg:npm/moment@2.24.0", "pkg:pypi/Django@2.1.2", "pkg:pypi/requests@2.23.0",
                          "pkg:pypi/tensorflow@2.1.0"])


def test_batch_of_one_equals_single(spark):
    sim = R.stored_similarity(spark, SMOKE)
    pk = R.stored_packages(spark, SMOKE)
    seeds = R._seed_purls(spark, SMOKE)
    single = recommend.recommend(sim, pk, seeds, 25)
    reqs = seeds.select(F.lit(1).cast("long").alias("request_id"), "purl")
    limits = reqs.sparkSession.createDataFrame([(1, 25)], "request_id long, max_recommendations long")
    batch = recommend.recommend_batch(sim, pk, reqs, limits)
    cols = ["package_a", "package_b", "score", "similarity"]
    a = [tuple(r) for r in single.select(*cols).collect()]
    b = [tuple(r) for r in batch.orderBy("rank").select(*cols).collect()]
    assert a == b and 0 < len(a) <= 25
    owned = {r.id for r in recommend.resolve_seeds(pk, recommend.seed_names(seeds)).collect()}
    assert not owned & {r.package_b for r in single.collect()}


def test_neighbour_prelimit_is_exact(spark):
    """Owned packages ranked first in a seed's list must not push real answers out."""
    from affinity.operators import similarity
    # seed 1's neighbours by similarity: 2 (owned), 3 (owned), 4, 5, 6; seed 2's: 1 (owned), 7
    rows = [(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (1, 5, 0.6), (1, 6, 0.5), (2, 7, 0.65), (2, 3, 0.95)]
    pairs = spark.createDataFrame(rows, "package_a long, package_b long, similarity double")
    sim = similarity.mirror_pairs(pairs).withColumn("bounded_similarity", F.lit(1))
    ranked = similarity.rank_neighbours(sim)
    seeds = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "request_id long, id long") \
        .withColumn("max_recommendations", F.lit(2).cast("long"))
    exact = recommend.candidates(sim, seeds.select("request_id", "id"), ["request_id"], 3)
    cut = recommend.candidates(ranked, seeds, ["request_id"], 3, limit="max_recommendations")
    top = lambda df: [(r.package_a, r.package_b) for r in df.orderBy(
        F.desc("similarity"), "package_a", "package_b").limit(2).collect()]
    assert top(cut) == top(exact) == [(1, 4), (2, 7)]
