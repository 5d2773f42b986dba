"""The hotspot engine against sequential checks, hand-made cases and DuckDB."""

import json
import math
import struct

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pyrocline import cli
from pyrocline.functions.geodesic import with_distance
from pyrocline.functions.utm import with_utm
from pyrocline.operators import bounds, clusters, density, mixture, raster, scoring
from pyrocline.operators.components import connected_components
from pyrocline.plans import catalog
from pyrocline.plans.engine import Run
from pyrocline.sources import detections, geotiff, outline, sinks

SMALL = "/root/testdata/sf0.001"
SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def points(spark, places, start=0):
    return spark.createDataFrame([(start + i, float(x), float(y)) for i, (x, y) in enumerate(places)], "det_id long, lon double, lat double")


def sequential(places, eps, least):
    """Textbook DBSCAN, seeds in row order; a border point goes to the neighbouring cluster with the smallest first core."""
    near = [[j for j, q in enumerate(places) if math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) <= eps] for p in places]
    core = [len(n) >= least for n in near]
    label, number = [-1] * len(places), 0
    for i in range(len(places)):
        if core[i] and label[i] < 0:
            label[i], todo = number, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = number
                        todo.append(j)
            number += 1
    for i in range(len(places)):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


def labels(frame, eps=0.006, least=4):
    return [r.label for r in sorted(density.cluster(frame, eps, least).collect())]


@pytest.mark.parametrize(("seed", "least"), [(1, 4), (2, 1), (3, 7)])
def test_density_clusters_match_a_sequential_run(spark, seed, least):
    draw = np.random.default_rng(seed)
    places = [*map(tuple, draw.uniform(0, 0.15, (250, 2)) - 0.05), *map(tuple, draw.normal(0.05, 0.004, (120, 2))), *[(0.02, 0.02)] * 9]
    assert labels(points(spark, places), least=least) == sequential(places, 0.006, least)


def test_density_edge_cases(spark):
    blob = [(0, 0), (0.001, 0), (0, 0.001), (0.001, 0.001), (0.0005, 0.0005)]
    assert labels(points(spark, blob)) == [0] * 5  # no noise: no cluster is lost
    assert labels(points(spark, [(k, k) for k in range(5)])) == [-1] * 5
    assert labels(points(spark, [(0, 0)])) == [-1]
    assert labels(points(spark, [])) == []
    assert labels(points(spark, [(0, 0), (0.006, 0), (0.012, 0)]), least=3) == [0, 0, 0]  # eps counts as near; ends are border points
    # Two components that share only a border point stay apart; it joins the first.
    left, right = [(-0.006, 0)] * 4, [(0.006, 0)] * 4
    assert labels(points(spark, [*left, (0, 0), *right]), least=10) == [-1] * 9
    assert labels(points(spark, [*left, (-0.0059, 0.003), (0, 0), *right, (0.0059, 0.003)]), least=5)[5] == 0
    frame = spark.createDataFrame([(1, None, 0.0), (2, 0.0, 0.0)], "det_id long, lon double, lat double")
    assert labels(frame, least=1) == [-1, 0]


def test_membership_keeps_five_and_renumbers(spark):
    found = spark.createDataFrame([(i, lab) for i, lab in enumerate([0] * 4 + [1] * 5 + [-1] * 7 + [2] * 6)], "det_id long, label long")
    kept = {r.det_id: r.cluster_id for r in clusters.membership(found).collect()}
    assert kept == {**dict.fromkeys(range(4, 9), 0), **dict.fromkeys(range(16, 22), 1)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    draw = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in draw.integers(-60, 60, (70, 2))] + [(k, k + 1) for k in range(100, 160)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(frame, few_edges=few).collect()} == {x: root(x) for x in parent}
    assert connected_components(frame.where("false"), few_edges=few).count() == 0


def test_geodesic(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (31.0, -104.0, 31.0, -104.0)], "a double, b double, c double, d double")
    found = [r.m for r in with_distance(rows, "a", "b", "c", "d", "m").collect()]
    assert found == pytest.approx([111319.4908, 110574.3886, 0.0], abs=1e-3)


def test_bounds(spark):
    place = [(0.5, 0.5), (0, 0.5), (0, 0), (1, 1), (0.5, 1), (1.5, 0.5), (2.5, 0.5), (-0.1, 0.5)]
    far = [(2.0, 0.0), (2.0, 1.0), (3.0, 1.0), (3.0, 0.0)]
    over = [(0.4, 0.4), (0.4, 0.6), (0.6, 0.6), (0.6, 0.4)]
    found = bounds.with_in_bounds(points(spark, place), [SQUARE, far, over]).orderBy("det_id").collect()
    assert [r.in_bounds for r in found] == [True, False, False, False, False, False, True, False]
    assert bounds.with_in_bounds(points(spark, place), []).where("in_bounds").count() == 8


def test_outline(spark, tmp_path):
    ring = [list(p) for p in SQUARE]
    multi = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
                                                       {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "o.json").write_text(json.dumps(multi, indent=1))
    assert outline.read_outline(spark, str(tmp_path / "o.json")) == [SQUARE] * 3
    assert outline.read_outline(spark, multi["features"][1]) == [SQUARE]
    assert outline.read_outline(spark, None) == []
    with pytest.raises(ValueError, match="holes"):
        outline.read_outline(spark, {"geometry": {"type": "Polygon", "coordinates": [ring, ring]}})


def test_collects_and_names(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fid long")
    assert tuple(clusters.distinct_collects(rows, 0.5).first()) == (3, 1)
    assert tuple(clusters.distinct_collects(rows.where("false"), 0.5).first()) == (0, 0)
    numbers = spark.createDataFrame([(7,), (12345,)], "cluster_id long")
    assert [r[0] for r in numbers.select(clusters.name_of("fires of june")).collect()] == ["fires_0007", "fires_12345"]


def test_locate(spark):
    rows = spark.createDataFrame([("POINT (-1.5 2e1)", None, 1), ("no point", "point(3 4)", 2), (None, None, 3)], "gmtco_point string, site_point string, frp int")
    assert [(r.lon, r.lat, r.frp) for r in detections.locate(rows).collect()] == [(-1.5, 20.0, 1.0), (3.0, 4.0, 2.0), (None, None, 3.0)]


def test_heatmap(spark):
    assert sum(w for *_, w in raster.kernel()) == pytest.approx(1)
    cells = {(r.row, r.col): r.weight for r in raster.heatmap(points(spark, [(0, 10), (10.5, 0.5), (5.2, 5.2), (5.2, 5.2)]), 1.0).collect()}
    assert sum(cells.values()) < 4
    assert cells[4, 5] == pytest.approx(2 * raster.kernel()[12][2], rel=1e-6)
    assert raster.heatmap(points(spark, [])).count() == 0


def test_statistics_of_equal_points(spark):
    rows = spark.createDataFrame([(i, 0, 1.0, 2.0, float(i), str(9 - i)) for i in range(5)], "det_id long, cluster_id long, lon double, lat double, frp double, uuid string")
    found = clusters.features(rows).first()
    assert (found.distance_mean, found.distance_stddev, found.distance_max, found.intensity_mean, found.intensity_max, found.order) == (0, 0, 0, 2.0, 4.0, "9")
    assert found.polygon == [[1.0, 2.0]] * 5


def test_mixture(spark):
    draw = np.random.default_rng(0)
    frame = points(spark, [*map(tuple, draw.normal(0, 0.1, (40, 2))), *map(tuple, draw.normal(5, 0.1, (40, 2)))])
    model = mixture.fit(frame, 2)
    hard = [r.label for r in mixture.assign(model, frame).orderBy("det_id").collect()]
    assert len(set(hard[:40])) == len(set(hard[40:])) == 1 and hard[0] != hard[-1]
    assert mixture.assign_soft(model, frame).count() == 80
    assert sorted(round(m[1]) for m in mixture.means(model)) == [0, 5]


def test_mixture_posteriors(spark):
    draw = np.random.default_rng(1)
    places = np.concatenate([draw.normal(0, 0.5, (60, 2)), draw.normal(1, 0.5, (60, 2))])
    frame = points(spark, [tuple(map(float, p)) for p in places])
    model = mixture.fit(frame, 2)
    density = np.empty((120, 2))
    for k, (weight, centre, spread) in enumerate(zip(model.weights, model.centres, model.spreads, strict=True)):
        away, cov = places - np.array(centre), spread
        density[:, k] = weight * np.exp(-0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov), away)) / np.sqrt(np.linalg.det(cov))
    share = density / density.sum(axis=1, keepdims=True)
    ids = [r.det_id for r in frame.orderBy("det_id").collect()]
    own = {(r.det_id, r.label): r.probability for r in mixture.assign_soft(model, frame, 0.0).collect()}
    assert len(own) == 240 and all(abs(own[i, k] - share[n, k]) < 1e-9 for n, i in enumerate(ids) for k in (0, 1))
    assert [r.label for r in mixture.assign(model, frame).orderBy("det_id").collect()] == share.argmax(axis=1).tolist()


def test_command_line(spark, tmp_path):
    blob = [(0.5 + 0.001 * k, 0.5) for k in range(6)] + [(0.8, 0.8), (9.0, 9.0)]
    lines = ["gmtco_point,FID,frp,uuid", *(f"POINT ({x} {y}),{k % 3},{k + 1},u{k}" for k, (x, y) in enumerate(blob))]
    (tmp_path / "fires of june.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "o.json").write_text(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}))
    (tmp_path / "m.json").write_text(json.dumps({"weights": [0] * 7 + [1], "intercept": -0.5}))
    paths = cli.main(["-f", str(tmp_path / "fires of june.csv"), "-b", str(tmp_path / "o.json"), "-o", str(tmp_path), "-m", str(tmp_path / "m.json"), "-v", "-l"])
    made = json.loads(open(paths["points"]).read())
    (feature,) = made["features"]
    assert feature["geometry"]["type"] == "Point" and feature["properties"]["name"] == "fires_0000"
    assert feature["properties"]["num_collects"] == 3 and feature["properties"]["num_in_cluster"] == 6 and feature["properties"]["model_prediction"] == "manmade"
    assert set(feature["properties"]) == set(sinks.PROPERTIES)
    (shape,) = json.loads(open(paths["polygons"]).read())["features"]
    assert shape["geometry"]["coordinates"][0][0] == shape["geometry"]["coordinates"][0][4] == [0.5, 0.5]
    assert spark.read.parquet(paths["heatmap"] + "/cells").count() > 0
    sinks.write_annotated(spark.createDataFrame([(1, None), (2, 3)], "det_id long, cluster_id long"), paths["annotated"])
    assert spark.read.csv(paths["annotated"], header=True).count() == 2
    nothing = Run(detections.detections(str(tmp_path / "fires of june.csv"), spark).withColumnRenamed("FID", "fid"), [[(50.0, 50.0), (50.0, 51.0), (51.0, 51.0)]])
    assert json.loads(open(nothing.write(str(tmp_path / "none"), "x.csv", None)["points"]).read())["features"] == []


def test_geotiff(spark, tmp_path):
    here = points(spark, [(0, 10), (3.5, 7.2)])
    cells = raster.heatmap(here, 1.0)
    assert geotiff.write_geotiff(cells, raster.extent(here), 1.0, str(tmp_path / "h.tif"))
    raw = (tmp_path / "h.tif").read_bytes()
    at, wide, tall = struct.unpack("<I", raw[4:8])[0], None, None
    for k in range(struct.unpack("<H", raw[at:at + 2])[0]):
        tag, _, _, value = struct.unpack("<HHII", raw[at + 2 + 12 * k:at + 14 + 12 * k])
        wide, tall = (value if tag == 256 else wide), (value if tag == 257 else tall)
    picture = np.frombuffer(raw[8:8 + 4 * wide * tall], "<f4").reshape(tall, wide)
    assert (tall, wide) == (3, 4)
    assert picture.sum() == pytest.approx(sum(r.weight for r in cells.collect()), rel=1e-5)
    assert not geotiff.write_geotiff(cells, raster.extent(here.where("false")), 1.0, str(tmp_path / "e.tif"))


def test_utm_and_corners(spark):
    frame = spark.createDataFrame([(0.0, 3.0), (45.0, 3.0), (0.0, 6.0)], "lat double, lon double")
    found = [(r.easting, r.northing) for r in with_utm(frame, 31).collect()]
    assert found[0] == pytest.approx((500000, 0), abs=1e-6)
    assert found[1] == pytest.approx((500000, 4982950.400), abs=0.01)
    assert found[2] == pytest.approx((833978.557, 0), abs=0.01)
    assert outline.corners(spark, [SQUARE, SQUARE]).count() == 10


def test_hierarchical_polygons(spark, tmp_path):
    rows = points(spark, [(0.001 * k, 0) for k in range(6)] + [(1, 1)]).selectExpr("*", "1D AS frp", "1L AS fid")
    made = json.loads(open(Run(rows).write_hierarchical(str(tmp_path), "a.csv")).read())
    assert len(made["features"]) == 1 and made["features"][0]["geometry"]["type"] == "Polygon"


def test_classifier_round_trip(spark, tmp_path):
    with pytest.raises(ValueError, match="weights"):
        (tmp_path / "m.json").write_text('{"weights": [1], "intercept": 0}')
        scoring.load(spark, str(tmp_path / "m.json"))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_sql(spark, name):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    found = catalog.queries()[name](spark, SMALL)
    wanted = base.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    at = [wanted.columns.index(c) for c in columns]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(show(r[i]) for i in at) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 23
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_mixture_has_a_component_for_each_piece(spark):
    folder = "/root/testdata/sf0.001"
    run = catalog._run(spark, folder)
    pieces = density.cluster(run.inside(), run.settings.pixel, 1).select("label").distinct().count()
    assert pieces > 12 and catalog.queries()["gmm_centroids"](spark, folder).count() == pieces


def test_one_component_is_the_points_own_spread(spark):
    from pyrocline.operators import mixture

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 1.0, 3.0), (4, None, 1.0)], "det_id long, lon double, lat double")
    model = mixture.fit(points, 1)
    assert mixture.means(model) == [(0, 1.0, 1.0)] and model.spreads[0].round(9).tolist() == [[round(2 / 3, 9), 0.0], [0.0, 2.0]]
    assert sorted((r.det_id, r.label) for r in mixture.assign(model, points).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_numbers_follow_the_key(spark):
    from pyrocline.operators.numbering import numbered

    rows = spark.createDataFrame([((k * 7919) % 1000,) for k in range(1500)] + [(None,)], "key long")
    assert sorted((r.key, r.n) for r in numbered(rows, "key", "n").collect()) == [(k, k) for k in range(1000)]
    assert numbered(rows.where("false"), "key", "n").count() == 0


def test_bounds_keep_columns_of_any_name(spark):
    from pyrocline.operators.bounds import with_in_bounds

    frame = spark.createDataFrame([(1, 0.5, 0.5, 7, 8), (2, 9.0, 9.0, 7, 8)], "det_id long, lon double, lat double, gx int, rings int")
    found = with_in_bounds(frame, [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]])
    assert found.columns == [*frame.columns, "in_bounds"] and [(r.det_id, r.gx, r.rings, r.in_bounds) for r in found.orderBy("det_id").collect()] == [(1, 7, 8, True), (2, 7, 8, False)]


def test_storage_needs_a_shared_folder_on_clusters(spark):
    import pytest

    from pyrocline import storage

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
    table = storage.settle(spark.range(3), "gone")
    assert table.count() == 3
    storage.forget(table)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist|FAILED_READ"):
        spark.read.schema("id long").parquet(table.inputFiles()[0]).count()


def test_entry_without_a_library(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("pyrocline.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def absent(name, *args, **more):
        if name == "zstandard" or name.startswith("pyrocline.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", absent)
    assert "dbscan_labels" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "dbscan_labels" in entry.oracle_sql()


def test_neighbours_are_counted_without_broadcasts(spark):
    draw = np.random.default_rng(5)
    places = [tuple(map(float, p)) for p in draw.integers(0, 60, (400, 2)) * 0.001]
    found = density.neighbour_counts(points(spark, places), 0.006)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    near = {i: sum(math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) <= 0.006 for q in places) for i, p in enumerate(places)}
    assert {r.det_id: r.neighbours for r in found.collect()} == near


def dense_rounds(places, labels, rounds):
    """Textbook expectation maximisation over all pairs, from labelled points."""
    count = labels.max() + 1
    weights = np.bincount(labels) / len(labels)
    means = np.array([places[labels == k].mean(axis=0) for k in range(count)])
    spreads = np.array([np.cov(places[labels == k].T, bias=True) for k in range(count)]) + 1e-6 * np.eye(2)
    for _ in range(rounds):
        away = places[:, None] - means
        logs = np.log(weights) - 0.5 * np.linalg.slogdet(spreads)[1] - 0.5 * np.einsum("nki,kij,nkj->nk", away, np.linalg.inv(spreads), away)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        own = share.sum(axis=0)
        weights, means = own / own.sum(), share.T @ places / own[:, None]
        away = places[:, None] - means
        spreads = np.einsum("nk,nki,nkj->kij", share, away, away) / own[:, None, None] + 1e-6 * np.eye(2)
    return weights, means, spreads


def pieces_and_outliers():
    draw = np.random.default_rng(6)
    places = np.concatenate([*(draw.normal(m, s, (50, 2)) for m, s in ((0, 0.02), (0.05, 0.03), (0.5, 0.01), (3, 1.0))), [[40.0, -30.0], [7.0, 7.0], [0.5, 0.5]]])
    return places, np.array([k for k in range(4) for _ in range(50)] + [4, 1, 5])


def test_mixture_of_pieces_equals_rounds_over_all_pairs(spark):
    places, labels = pieces_and_outliers()
    frame = points(spark, places).unionByName(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0)], "det_id long, lon double, lat double"))
    pieces = spark.createDataFrame([*enumerate(labels.tolist()), (900, -1)], "det_id long, label long")
    weights, means, spreads = dense_rounds(places, labels, 12)
    for few in (1000, 0):
        model = mixture.fit_pieces(frame, pieces, rounds=12, tol=0.0, few_points=few)
        assert np.abs(np.array(model.weights) - weights).max() < 1e-9 and np.abs(np.array(model.spreads) - spreads).max() < 1e-9
        assert np.abs(np.array(mixture.means(model)) - np.column_stack([np.arange(6), means])).max() < 1e-9


def test_pairs_done_in_parts_change_no_sum(monkeypatch):
    from pyrocline.operators import ellipses

    places, labels = pieces_and_outliers()
    of, found = ellipses.forms(*dense_rounds(places, labels, 2)), []
    for most in (400_000, 30):
        monkeypatch.setattr(ellipses, "MOST_PAIRS", most)
        into = np.zeros((6, 6))
        found.append((ellipses.sums(places[:, 0].copy(), places[:, 1].copy(), of, into), into))
    assert abs(found[0][0] - found[1][0]) < 1e-8 and np.abs(found[0][1] - found[1][1]).max() < 1e-9 and abs(found[0][1][:, 0].sum() - len(places)) < 1e-9


def test_mixture_query_ends_on_thousands_of_pieces(spark):
    folder = "/root/testdata/sf0.01"
    assert catalog.queries()["gmm_centroids"](spark, folder).count() > 2000


def test_hard_assignment_to_thousands_of_components(spark):
    draw = np.random.default_rng(8)
    centres, places = draw.uniform(0, 3, (3000, 2)), draw.uniform(-1, 4, (2000, 2))
    model = mixture.Mixture(np.full(3000, 1 / 3000), centres, np.broadcast_to(1e-4 * np.eye(2), (3000, 2, 2)))
    found = mixture.assign(model, points(spark, places))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000 and "MapInArrow" in plan
    nearest = ((places[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.det_id: r.label for r in found.collect()} == dict(enumerate(nearest.tolist()))
    twins = mixture.Mixture((0.5, 0.5), ((1.0, 1.0), (1.0, 1.0)), (np.eye(2), np.eye(2)))
    assert [r.label for r in mixture.assign(twins, points(spark, [(1, 1), (900, 4)])).collect()] == [0, 0]


def test_soft_assignment_to_thousands_of_components(spark):
    draw = np.random.default_rng(9)
    centres, places = draw.uniform(0, 3, (3000, 2)), draw.uniform(-1, 4, (2000, 2))
    model = mixture.Mixture(np.full(3000, 1 / 3000), centres, np.broadcast_to(1e-4 * np.eye(2), (3000, 2, 2)))
    found = mixture.assign_soft(model, points(spark, places))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000 and "MapInArrow" in plan
    logs = -0.5e4 * ((places[:, None] - centres) ** 2).sum(axis=2)
    share = np.exp(logs - logs.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    own = {(r.det_id, r.label): r.probability for r in found.collect()}
    assert set(own) == set(zip(*(x.tolist() for x in np.nonzero(share > 0.4)), strict=True)) and all(abs(p - share[k]) < 1e-9 for k, p in own.items())
    few = mixture.Mixture((0.5, 0.5), ((0.0, 0.0), (12.0, 0.0)), (np.eye(2), np.eye(2)))
    assert sorted(r.label for r in mixture.assign_soft(few, points(spark, [(0, 0)]), 0.0).collect()) == [0, 1]


def test_stored_tables_free_the_driver(spark, monkeypatch):
    from pyrocline import storage

    monkeypatch.setattr(storage, "FREE_SECONDS", 0.0)

    def whole_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(bean.getCollectionCount() for bean in beans if "Young" not in bean.getName())

    before = whole_collections()
    assert storage.settle(spark.range(3), "three").count() == 3 and whole_collections() > before
