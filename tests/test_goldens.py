"""Published results: folds from component sizes, and intervals from what components sum to."""

import pytest

from strandwise.operators import graph as G
from strandwise.operators import metrics as M

# Published components, with rows, fold, and the sums of the ridge's absolute errors less the nearest
# neighbours', for GCGR, GLP-1R and selectivity.
COMPONENTS = {
    "SC001": (40, 1, 2.581756507272136, 11.987043080818022, 10.690140316682845),
    "SC002": (34, 2, 6.376720207549074, 1.2108084392336638, -3.1296305196769776),
    "SC003": (16, 3, -7.880359055635903, -10.350379558522704, -3.161898321731397),
    "SC004": (12, 3, -23.316235725801032, -20.35552165543668, -2.7578864191610966),
    "SC005": (4, 3, -0.37004372072511016, -0.1530599165119204, -0.21698380421318975),
    "SC006": (4, 3, 1.6953898213017604, -1.8152697680690348, 1.0190998270689573),
    "SC007": (3, 2, 1.4373603829861654, -0.6969811891633837, 0.1541664798224156),
    "SC008": (2, 3, -0.3626800509896908, 3.748926707258779, 2.455351552191699),
    "SC009": (2, 2, 1.9304455224901158, 0.34691441749387675, -1.583531104996239),
    "SC010": (1, 3, 0.1645942471377424, 0.011563422077608854, -0.0644631662561228),
    "SC011": (1, 2, 1.0815301260254726, 1.8270224981087475, 0.7454923720832749),
    "SC012": (1, 3, -0.5912320568251443, 0.6551396812897061, 1.2463717381148505),
    "SC013": (1, 1, 0.17963993761858266, 0.5094077869970826, 0.6890477246156652),
    "SC014": (1, 2, -0.9774703489578087, 0.8439897382775672, -0.13348061068024153),
    "SC015": (1, 3, -0.3483331893240744, -0.2524391177012517, 0.5719168228410054),
    "SC016": (1, 1, -0.008112115158624533, -0.43622434066072274, -0.16002391962256413),
    "SC017": (1, 2, 0.6377994820004185, -0.6135790565605774, -1.2513785386609957),
}
# Mean and interval of each endpoint's difference.
INTERVALS = {
    "gcgr": (-0.1421538402322873, -0.7790162421387624, 0.18216244113397465),
    "glp1r": (-0.10826111064936973, -0.7273762818433716, 0.2489188883238488),
    "selectivity": (0.04089848342737513, -0.13855903823374047, 0.22907842839579742),
}
# The external components, with rows and sums of differences of both receptors, and their intervals.
EXTERNAL = {
    "EC001": (5, 1.9227936701981134, 0.4551751961730839),
    "EC002": (5, -1.5452983988209787, 6.898930960297958),
    "EC003": (1, 0.13577520484602257, -2.1198565046273545),
    "EC004": (4, -4.121098634847838, -0.17606467401230508),
}
EXTERNAL_INTERVALS = {"gcgr": (-0.2405218772416454, -0.8181526060802642, 0.343094812507356), "glp1r": (0.3372123318554255, -0.7380492897136224, 1.0800383266779772)}


def test_greedy_folds(spark):
    clusters = spark.createDataFrame([(c, n) for c, (n, *_) in COMPONENTS.items()], "root string, size long")
    folds = {r.root: r.fold for r in G.greedy_folds(clusters).collect()}
    assert folds == {c: fold for c, (_, fold, *_) in COMPONENTS.items()}
    assert sorted(sum(n for c, (n, *_) in COMPONENTS.items() if folds[c] == f) for f in (1, 2, 3)) == [41, 42, 42]


def intervals(spark, components, endpoints):
    """Rows of a component that sum to what it does."""
    rows = [(e, c, total / n) for c, (n, *sums) in components.items() for e, total in zip(endpoints, sums, strict=True) for _ in range(n)]
    df = spark.createDataFrame(rows, "endpoint string, component string, delta double")
    return {r.endpoint: r for r in M.seeded_bootstrap(df, ["endpoint"], "component", "delta").collect()}


def test_seeded_intervals(spark):
    for components, wanted in (({c: (n, *sums) for c, (n, _, *sums) in COMPONENTS.items()}, INTERVALS), (EXTERNAL, EXTERNAL_INTERVALS)):
        got = intervals(spark, components, list(wanted))
        for endpoint, want in wanted.items():
            g = got[endpoint]
            assert g.groups == len(components)
            assert (g.mean_delta, g.low, g.high) == pytest.approx(want, rel=1e-7)


def test_draws_do_not_depend_on_how_many_are_made_at_once():
    import numpy as np

    sums, sizes = np.array([1.0, -2.0, 0.5]), np.array([2, 3, 1])
    assert np.array_equal(M.drawn_means(sums, sizes, 1000, 7), M.drawn_means(sums, sizes, 1000, 7, at_once=30))
