from pyspark.sql import functions as F

from factweave.operators import patterns

FLOW = "f int, output string, input string, pos int, mnemonic string, constant bigint"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_fixed_effects_and_their_binding(spark):
    flow = spark.createDataFrame([(1, "a", "p0", 0, "INT_ADD", None), (1, "a", "8", 1, "INT_ADD", 8), (1, "b", "p0", 0, "INT_ADD", None), (1, "b", "i", 1, "INT_ADD", None)], FLOW)
    stores = spark.createDataFrame([(1, "s1", "a", "v1"), (1, "s2", "b", "v2"), (1, "s3", "p1", "v3"), (1, "s4", "x", "v4")], "f int, site string, address string, value string")
    formals = spark.createDataFrame([(1, 0, "p0"), (1, 1, "p1")], "f int, slot int, node string")
    e = patterns.fixed_effects(flow, stores, formals, ["f"])
    assert rows(e, "site", "slot", "offset", "value") == [("s1", 0, 8, "v1"), ("s3", 1, 0, "v3")]
    calls = spark.createDataFrame([("c1", "g", 0, "obj:x"), ("c2", "g", 0, "obj:y")], "call_site string, callee string, slot int, object string")
    effects = spark.createDataFrame([("g", f"s{i}", 0, 4, f"v{i}") for i in range(3)], "function string, site string, slot int, offset bigint, value string")
    good, bad = patterns.bind_effects(effects, calls, 3)
    assert good.count() == 6 and bad.count() == 0
    good, bad = patterns.bind_effects(effects, calls, 2)
    assert good.count() == 0 and rows(bad, "call_site", "offset") == [("c1", 4), ("c2", 4)]


def test_constants_fold_and_merges_must_agree(spark):
    flow = [
        (1, "a", "c2", 0, "COPY", 2), (1, "b", "a", 0, "INT_ADD", None), (1, "b", "c3", 1, "INT_ADD", 3), (1, "m", "b", 0, "MULTIEQUAL", None), (1, "m", "c5", 1, "MULTIEQUAL", 5),
        (1, "n", "b", 0, "MULTIEQUAL", None), (1, "n", "a", 1, "MULTIEQUAL", None), (1, "u", "b", 0, "INT_SUB", None), (1, "u", "q", 1, "INT_SUB", None), (1, "d", "b", 0, "INT_SUB", None), (1, "d", "a", 1, "INT_SUB", None),
        (1, "l", "a", 0, "INT_LEFT", None), (1, "l", "c3", 1, "INT_LEFT", 3),
    ]
    assert rows(patterns.resolve_constants(spark.createDataFrame(flow, FLOW), ["f"]), "value", "number") == [("a", 2), ("b", 5), ("d", 3), ("l", 16), ("m", 5)]


def test_regions_are_cut_and_shifted_by_copies(spark):
    seeds = spark.createDataFrame([("L", "o", 4, 12)], "lineage string, object string, start bigint, end bigint")
    copies = spark.createDataFrame([("o", 0, 8, "p", 100), ("p", 102, 200, "q", 0), ("o", 20, 30, "z", 0), ("q", 0, 4, "o", 4)], "src string, src_start bigint, src_end bigint, dst string, dst_start bigint")
    got = patterns.propagate_regions(seeds, copies)
    assert got.complete and rows(got.rows, "object", "start", "end") == [("o", 4, 12), ("o", 6, 8), ("p", 104, 108), ("p", 106, 108), ("q", 2, 6), ("q", 4, 6)]


def test_container_aliases(spark):
    flow = [
        (1, "head", "p0", 0, "LOAD", None), (1, "it", "head", 0, "MULTIEQUAL", None), (1, "it", "next", 1, "MULTIEQUAL", None), (1, "addr", "it", 0, "INT_ADD", None), (1, "addr", "8", 1, "INT_ADD", 8), (1, "next", "addr", 0, "LOAD", None),
        (2, "it", "p0", 0, "MULTIEQUAL", None), (2, "it", "next", 1, "MULTIEQUAL", None), (2, "next", "it", 0, "INT_ADD", None),
    ]
    formals = spark.createDataFrame([(1, 0, "p0"), (2, 0, "p0")], "f int, slot int, node string")
    assert rows(patterns.container_aliases(spark.createDataFrame(flow, FLOW), formals, ["f"]), "f", "phi", "slot", "kept") == [(1, "it", 0, True)]


def test_counted_and_sentinel_loops(spark):
    k = ["f"]
    sites = [("copy", "d", "ld"), ("fill", "d", "inv"), ("var", "d", "zz"), ("wild", "w", "inv"), ("ext", "d", "lx"), ("skew", "d", "l2"), ("none", None, "inv")]
    stores = spark.createDataFrame([(1, s, "b1", a, v) for s, a, v in sites] + [(1, "out", "b9", "d", "ld"), (2, "norec", "b1", "d", "ld")], "f int, site string, block string, address string, value string")
    loops = spark.createDataFrame([(1, "h", "b1"), (2, "h", "b1")], "f int, header string, block string")
    recurrences = spark.createDataFrame([(1, "h", "i", 4)], "f int, header string, phi string, step int")
    progress = spark.createDataFrame([(1, "h", "d", 4), (1, "h", "s", 4), (1, "h", "s2", 8)], "f int, header string, node string, stride int")
    loads = spark.createDataFrame([(1, "ld", "s", False), (1, "lx", "s", True), (1, "l2", "s2", False)], "f int, value string, load_address string, external boolean")
    inv = spark.createDataFrame([(1, "h", "inv")], "f int, header string, value string")
    got = patterns.counted_ranges(stores, loops, recurrences, recurrences, progress, loads, inv, k)
    assert {r.site: r.kind or r.reason for r in got.collect()} == {
        "copy": "COPY", "fill": "FILL", "var": "counted_range_fill_value_not_invariant", "wild": "counted_range_destination_not_fixed_stride", "ext": "excluded_external_input_source",
        "skew": "counted_range_source_destination_stride_mismatch", "none": "malformed_store_operands", "norec": "counted_range_no_fixed_stride_recurrence",
    }
    tests = spark.createDataFrame([(1, "h", "ld")], "f int, header string, value string")
    got = {r.site: r.reason for r in patterns.sentinel_copies(stores.filter("f = 1"), loops, progress, loads, tests, k).collect()}
    assert got["copy"] is None and got["fill"] == "sentinel_value_not_an_unchanged_load" and got["ext"] == "sentinel_exit_does_not_test_the_value" and got["skew"] == "sentinel_stride_mismatch"


def test_capacity_needs_an_unsigned_constant_bound_within_the_rest(spark):
    sinks = spark.createDataFrame([(s, "COPY_SINK", 1) for s in "abcdefgh"] + [("i", "OTHER", 1), ("j", "COPY_SINK", 2)], "sink string, label string, lengths int")
    c = [("a", "INT_LESS", "LE", 16, True), ("b", "INT_LESS", "LT", 18, True), ("c", "INT_SLESS", "LT", 4, True), ("d", "INT_LESS", "GT", 4, True), ("e", "INT_LESS", "LT", 4, False), ("f", "INT_LESS", "LT", None, True), ("h", "INT_LESS", "LT", 4, True), ("a", "INT_LESS", "LE", 99, True)]
    checks = spark.createDataFrame(c, "sink string, mnemonic string, relation string, bound bigint, equivalent boolean")
    dest = spark.createDataFrame([(s, 20, 4) for s in "abcdefg"], "sink string, extent bigint, offset bigint")
    got = {r.sink: r.reason for r in patterns.capacity_proofs(sinks, checks, dest).collect()}
    assert got == {
        "a": None, "b": "check_bound_exceeds_remaining_destination_capacity", "c": "signed_comparison_not_capacity_proof", "d": "unsupported_capacity_bound_relation", "e": "checked_value_not_equivalent_to_sink_length",
        "f": "capacity_bound_not_constant", "g": "no_parameter_bounded_check", "h": "static_destination_object_unresolved", "i": "sink_label_not_supported_by_capacity_proof", "j": "non_unique_nonconstant_length_parameter",
    }


def test_ordered_admissions(spark):
    df = spark.createDataFrame([(1, True, None, None), (2, False, True, 0), (3, False, False, 1), (4, False, False, 2), (5, False, False, 0), (6, False, False, None)], "id int, a boolean, b boolean, n int")
    got = patterns.parser_reads(df, F.col("a"), F.col("b"), F.col("n"))
    assert [x[1:] for x in rows(got, "id", "path", "reason")] == [("DYNAMIC_TERM", None), ("SOURCE_CONTROLLED_LOOP", None), ("SHARED_SOURCE_LENGTH", None), (None, "available_length_ambiguous"), (None, "available_length_missing"), (None, "no_source_relation")]
    df = spark.createDataFrame([(1, True, True, "formal", True), (2, True, True, "other", True), (3, True, None, "formal", True), (4, None, None, None, None), (5, True, True, "source", False)], "id int, complete boolean, writable boolean, offset_kind string, trackable boolean")
    assert [x[1] for x in rows(patterns.variable_stores(df), "id", "reason")] == [None, "offset_neither_formal_nor_source", "base_not_proved_writable", "address_not_complete", "no_trackable_parameter"]
    df = spark.createDataFrame([(1, "BOUND", "o", None, None, True, True, None), (2, "BOUND", "", "", True, None, None, None), (3, "OPEN", "o", "v", True, None, None, None), (4, "BOUND", None, "v", None, None, None, None)], "id int, binding_status string, object_id string, value_id string, argument_facts boolean, argument_text boolean, length_from_return boolean, receive_like boolean")
    assert [x[1:] for x in rows(patterns.source_candidates(df), "id", "rule", "reason")] == [("ARGUMENT_WRITTEN_BY_BODY", None), (None, "binding_incomplete"), (None, "binding_incomplete"), (None, "no_rule_holds")]
    df = spark.createDataFrame([(1, "RX_DATA", None), (2, "STATUS", None), (3, None, None), (4, "RX_DATA", "table_unresolved")], "id int, role string, t string")
    assert [x[1:] for x in rows(patterns.route_registers(df, F.col("role"), F.col("t")), "id", "route", "reason")] == [("SOURCE", None), ("RAW", "register_role_status"), ("RAW", "register_role_unresolved"), ("RAW", "table_unresolved")]


def test_containers_queues_and_callbacks(spark):
    stores = spark.createDataFrame([("put", 1, 0, 8), ("self", 0, 0, 8), ("none", None, 0, 8)], "function string, value_slot int, address_slot int, offset bigint")
    returns = spark.createDataFrame([("get", 1, 0, 8), ("two", 2, 0, 8)], "function string, values int, address_slot int, offset bigint")
    assert rows(patterns.container_summaries(stores, returns), "function", "kind", "container_slot", "value_slot") == [("get", "REMOVE", 0, None), ("put", "INSERT", 0, 1)]
    w = spark.createDataFrame([("w", "q", 0, 4), ("w", "q", 4, 4), ("w2", "q", 0, 4), ("w3", "q", 0, 1), ("w3", "q", 4, 1)], "function string, object string, offset bigint, size int")
    r = spark.createDataFrame([("r", "q", 0, True), ("r", "q", 4, True), ("r2", "q", 0, True), ("r2", "q", 4, False)], "function string, object string, offset bigint, dispatched boolean")
    assert rows(patterns.event_queues(w, r), "object", "writer", "reader", "offsets") == [("q", "w", "r", [0, 4])]
    stored = spark.createDataFrame([("register", 1)], "function string, slot int")
    f = spark.createDataFrame([("wrap", "register", 1, 0, None), ("main", "wrap", 0, None, "handler"), ("main", "register", 1, None, "direct"), ("main", "other", 1, None, "no")], "caller string, callee string, slot int, caller_slot int, target string")
    good, bad = patterns.callback_registrations(stored, f)
    assert rows(good, "function", "target") == [("register", "direct"), ("wrap", "handler")] and bad.count() == 0
    assert patterns.callback_registrations(stored, f, most=0)[0].count() == 0


def test_best_chains_and_rank_metadata(spark):
    e = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "sink string, matched boolean")
    c = spark.createDataFrame([("s1", "c2", False, "SOURCE_REACHED_HEURISTIC"), ("s1", "c1", True, "GRAPH_INCOMPLETE"), ("s1", "c0", False, "PROVEN_INTERNAL_ONLY"), ("s3", "c9", True, "GRAPH_INCOMPLETE")], "sink string, chain string, source_matched boolean, status string")
    assert rows(patterns.best_chains(e, c, "sink"), "sink", "chain", "result") == [("s1", "c1", "GRAPH_INCOMPLETE"), ("s2", None, "CHAIN_MISS"), ("s3", "c9", "SINK_MISS")]
    df = spark.createDataFrame([(1, [0.123456, 2.0], ["ISR", "DMA"]), (2, [], []), (3, None, ["x"])], "id int, s array<double>, h array<string>")
    best, hint = patterns.rank_metadata(F.col("s"), F.col("h"), ["DMA", "ISR", "TASK"])
    assert rows(df, "id", best.alias("b"), hint.alias("h")) == [(1, 1.0, "DMA"), (2, 0.0, "TASK"), (3, 0.0, "TASK")]


def test_swaps_and_reservations(spark):
    t = [(1, "h", "s1", "buf", "i", "j"), (1, "h", "s2", "buf", "j", "i"), (1, "h", "s3", "buf", "i", "k"), (1, "g", "s4", "buf", "j", "i"), (1, "h", "s5", None, "j", "i"), (1, "h", "s6", "buf", "i", "i")]
    got = patterns.in_place_swaps(spark.createDataFrame(t, "f int, header string, site string, base string, dst string, src string"), ["f"])
    assert rows(got, "header", "site_a", "site_b") == [("h", "s1", "s2")]
    u = spark.createDataFrame([(1, "u1", "b", 4, "old", "add"), (1, "u2", "b", 4, "old", "sub"), (1, "u3", "b", 4, "other", "add"), (1, "u4", "b", 0, "old", "add"), (1, "u5", "b", 4, None, "add")], "f int, site string, base string, field int, old_value string, direction string")
    r = spark.createDataFrame([(1, "ret", "b", 0, "old"), (1, "ret2", "c", 0, "other")], "f int, return_site string, base string, pointer_field int, value string")
    assert rows(patterns.buffer_reservations(u, r, ["f"]), "site", "return_site", "reason") == [
        ("u1", "ret", None), ("u2", "ret", "reservation_update_does_not_add"), ("u3", None, "reservation_return_does_not_depend_on_old_value"), ("u4", None, "reservation_pointer_is_the_updated_field"), ("u5", None, "reservation_old_value_unknown"),
    ]
