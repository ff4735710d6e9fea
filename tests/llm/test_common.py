import random

import brute

from tidemark.llm.common import connected_components


def test_components_of_paths_stars_and_repeated_links(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 400)
    links = [(ids[i], ids[i + 1]) for i in range(100)]  # one long path in random order
    links += [(ids[150], ids[i]) for i in range(151, 250)]  # a star
    links += [(ids[i], ids[rng.randrange(260, 400)]) for i in range(260, 400)]
    links += links[:20] + [(ids[3], ids[3])]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == brute.groups(nodes, links)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
