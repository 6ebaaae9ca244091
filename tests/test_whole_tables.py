"""Queries without SQL, over every row of small tables, against brute force."""

from collections import Counter

from hyperslice.plans.queries import QUERIES


def test_communities_take_every_order(spark, tmp_path):
    people, orders = 40, [(k, k * k * 7 % 40) for k in range(90)]
    spark.range(people).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    links = {frozenset((c, k % people)) for k, c in orders}
    near = {n: [m for link in links if n in link for m in link - {n} or link] for n in range(people)}
    label = {n: n for n in range(people)}
    for _ in range(5):
        votes = {n: Counter([label[n], *(label[m] for m in near[n])]) for n in near}
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    sizes = Counter(label.values())
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    found = {r.id: (r.community, r["size"]) for r in QUERIES["communities"](spark, str(tmp_path)).collect()}
    assert found == {n: (order.index(x), sizes[x]) for n, x in label.items()}
