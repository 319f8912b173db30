"""Every operator as a query over the given tables, with flat, comparable columns."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave import constants as K
from scanweave.functions import dates, fields, fuzzy, gender, geometry, pin, text
from scanweave.functions.address import PARTS, parse_address
from scanweave.operators import (
    address, calibration, cheque, consensus, dob, layout, profile, reads, refine, templates,
)
from scanweave.operators import gender as gender_op
from scanweave.plans import jobs, recipes
from scanweave.shipping import ship
from scanweave.sources import intake, sinks
from scanweave.sources.shared import discard, settle

QUERIES = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark, d):
        ship(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


def flat(df: DataFrame, *keep, **structs) -> DataFrame:
    """Struct columns to prefixed plain columns."""
    columns = [F.col(c) for c in keep]
    for prefix, (col, names) in structs.items():
        columns += [F.col(f"{col}.{n}").alias(f"{prefix}_{n}") for n in names]
    return df.select(*columns)


EDGES = ("x1", "y1", "x2", "y2")


# --- intake ------------------------------------------------------------------------
@query
def intake_validation(spark, d):
    pages = recipes.table(spark, d, "pages").select(
        "page_id", (F.length("html").cast("long") * (F.col("page_id") % 1201)).alias("length"),
        recipes.pick(recipes.MIMES, F.col("page_id") % 6).alias("mime"))
    return intake.with_intake_error(pages)


@query
def requested_fields(spark, d):
    k = F.col("event_id")
    asked = recipes.table(spark, d, "events").select(
        "event_id", fields.parse_fields(recipes.pick(recipes.PAYLOADS, k % len(recipes.PAYLOADS))).alias("p"))
    wanted = F.col("p.fields")
    return asked.select(
        "event_id", F.array_join(wanted, ",").alias("fields"), F.col("p.error").alias("error"),
        F.array_join(fields.selected_primary(wanted), ",").alias("selected"),
        F.array_join(fields.public_engine_fields(wanted), ",").alias("public_fields"),
        F.array_join(fields.required_engine_fields(wanted), ",").alias("required_fields"))


@query
def account_search(spark, d):
    # Each account is looked for by the part of its name and number a clerk would type.
    accounts = recipes.bank_accounts(spark, d)
    return cheque.search_accounts(accounts, "Widget").unionByName(cheque.search_accounts(accounts, "0012"))


@query
def recogniser_lines(spark, d):
    lines = intake.recogniser_lines(recipes.recogniser_json(spark, d))
    return lines.select("doc_id", "line_no", "text", "score", geometry.box_bounds(F.col("box")).alias("b"), "fault").select(
        "doc_id", "line_no", "text", "score", *[F.col(f"b.{e}").alias(e) for e in EDGES], "fault")


# --- text --------------------------------------------------------------------------
def _lines(spark, d, fn, name="clean_text"):
    return recipes.ocr_lines(spark, d).select("doc_id", "line_no", fn(F.col("text")).alias(name))


@query
def clean_generic(spark, d):
    return _lines(spark, d, text.clean_generic)


@query
def clean_name(spark, d):
    return _lines(spark, d, text.clean_name)


@query
def clean_address_line(spark, d):
    return _lines(spark, d, text.address_line)


@query
def label_text(spark, d):
    return recipes.ocr_lines(spark, d).select(
        "doc_id", "line_no", text.anchor_text(F.col("text")).alias("anchor_text"),
        text.plain_text(F.col("text")).alias("plain_text"))


@query
def pin_extract(spark, d):
    return recipes.pin_texts(spark, d).select("doc_id", "text", pin.clean_pin(F.col("text")).alias("pin"))


@query
def pin_lines(spark, d):
    return _lines(spark, d, pin.clean_pin, "pin")


@query
def pin_raw(spark, d):
    return _lines(spark, d, pin.pin_digits, "pin")


@query
def dob_parts(spark, d):
    return recipes.dob_parts(spark, d).select(
        "doc_id", "day", "month", "year",
        dates.dob_from_parts(F.col("day"), F.col("month"), F.col("year")).alias("dob"))


@query
def dob_text(spark, d):
    joined = recipes.dob_parts(spark, d).select(
        "doc_id", F.concat(F.lit("X "), F.concat_ws("-", "day", "month", "year")).alias("text"))
    return joined.select("doc_id", "text", dates.clean_dob(F.col("text")).alias("dob"))


@query
def dob_lines(spark, d):
    return _lines(spark, d, dates.clean_dob, "dob")


@query
def account_number(spark, d):
    return recipes.table(spark, d, "documents").select(
        "doc_id", text.account_number(F.col("text")).alias("account_number"))


@query
def holder_name(spark, d):
    return recipes.table(spark, d, "conversations").select(
        "conv_id", "turn", text.holder_name(F.col("text")).alias("holder_name"))


@query
def state_match(spark, d):
    return recipes.state_texts(spark, d).select(
        "doc_id", "text", fuzzy.fuzzy_choice(text.clean_state_text(F.col("text"))).alias("state"))


# --- reads and votes ----------------------------------------------------------------
@query
def read_assembly(spark, d):
    return reads.assemble_reads(recipes.ocr_lines(spark, d), ("doc_id",))


@query
def expected_reads(spark, d):
    lines = recipes.ocr_lines(spark, d).where("box is not null")
    wanted = recipes.table(spark, d, "documents").select("doc_id")
    done = reads.assemble_reads(lines, ("doc_id",)).select("doc_id", "raw_text", "confidence")
    return reads.with_expected_reads(done, wanted, ("doc_id",))


@query
def document_text(spark, d):
    return reads.document_text(recipes.ocr_lines(spark, d))


@query
def consensus_vote(spark, d):
    return consensus.consensus(recipes.ocr_reads(spark, d))


@query
def name_vote(spark, d):
    return consensus.consensus(recipes.name_reads(spark, d))


def _address_reads(spark, d):
    k = F.col("o_orderkey")
    streets = recipes.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("street"))
    orders = recipes.table(spark, d, "orders").select("o_orderkey", (k % recipes.part_count(spark, d)).alias("p_partkey"))
    windows = F.explode(F.sequence(F.lit(0), F.lit(19)))
    r = F.col("r")
    damaged = recipes.replace_letter(F.col("street"), (k + r * 3) % F.length("street"), "X")
    # by order again, while there is one row of each
    found = recipes.spread(orders.join(streets, "p_partkey"), "o_orderkey")
    return found.select("o_orderkey", "street", windows.alias("r")).select(
        k.alias("doc_id"), (r % 5).alias("line_idx"), r.cast("long").alias("ordinal"),
        F.when(F.floor(r / 5) % 2 == 0, "base").otherwise("prepared").alias("variant"),
        F.when((k + r % 5) % 4 == 0, "").when((k + r) % 3 == 0, damaged).otherwise(F.col("street")).alias("raw_text"),
        ((k * 7 + r * 5) % 64 / 64.0).alias("confidence"))


@query
def address_vote(spark, d):
    out = address.address_vote(_address_reads(spark, d))
    return out.select("doc_id", "raw_text", "clean_text", "confidence", F.array_join("address_lines", "|").alias("address_lines"))


@query
def address_fallback(spark, d):
    lines = recipes.ocr_lines(spark, d).withColumn("ordinal", F.col("line_no") % 2)
    out = address.fallback_read(lines)
    return out.select("doc_id", "raw_text", "clean_text", "confidence", F.array_join("address_lines", "|").alias("address_lines"))


@query
def digit_votes(spark, d):
    return dob.box_winners(dob.digit_votes(recipes.box_reads(spark, d)))


@query
def boxed_dob(spark, d):
    return dob.boxed_dob(recipes.dated_box_reads(spark, d))


@query
def tail_hint(spark, d):
    return dob.tail_hint(recipes.tail_reads(spark, d))


@query
def segment_pick(spark, d):
    return dob.segment_winners(recipes.segment_reads(spark, d))


@query
def dob_cascade(spark, d):
    tails = recipes.tail_reads(spark, d).withColumn("crop", F.lit(0))
    whole = recipes.dob_parts(spark, d).select(
        "doc_id", F.concat_ws(" ", "day", "month", "year").alias("raw_text"),
        F.lit(0.5).alias("confidence"), F.lit(0).cast("long").alias("ordinal"))
    return dob.resolve_dob(recipes.dated_box_reads(spark, d), tails, recipes.segment_reads(spark, d), whole)


@query
def dob_boxes(spark, d):
    return dob.found_boxes(recipes.contour_boxes(spark, d)).select(
        "doc_id", F.size("boxes").alias("n_boxes"),
        F.array_join(F.transform("boxes", lambda b: F.concat_ws(",", b["x"], b["y"], b["w"], b["h"])), " ").alias("boxes"))


@query
def gender_resolve(spark, d):
    scored = gender_op.gender_scores(recipes.checkbox_scores(spark, d)).withColumn("g", gender.resolve_gender(F.col("scores")))
    return scored.select(
        "doc_id", F.col("g.gender").alias("gender"),
        gender.merge_confidence(F.lit(0.25), F.col("g.confidence")).alias("confidence"))


@query
def gender_windows(spark, d):
    return gender_op.checkbox_windows(recipes.gender_lines(spark, d))


# --- address ------------------------------------------------------------------------
def _line_arrays(spark, d):
    doc = F.col("doc_id")
    return recipes.table(spark, d, "documents").select(
        "doc_id", "text", (100000 + doc % 900000).cast("string").alias("pin"),
        recipes.pick(K.STATES, doc % 36).alias("state"),
        F.when(doc % 3 != 0, F.split("text", "\n")).alias("lines"))


@query
def address_parse(spark, d):
    a = _line_arrays(spark, d).withColumn(
        "a", parse_address(F.col("text"), F.col("pin"), F.col("state"), F.col("lines")))
    return flat(a.withColumn("lines_out", F.array_join("a.line_items", "|")), "doc_id", "lines_out",
                a=("a", ("full_address", *PARTS, "pin_code", "country")))


@query
def address_repair(spark, d):
    names = _address_reads(spark, d).where("line_idx = 0").groupBy("doc_id").agg(F.max("raw_text").alias("street"))
    known = F.upper("street")
    damaged = recipes.replace_letter(known, F.col("doc_id") % F.greatest(F.length(known), F.lit(1)), "X")
    lines = F.array(F.concat(F.lit("S/O "), damaged), F.lit("HIGH STREET"))
    profiles = names.select(
        "doc_id", F.lit("").alias("father_name"), known.alias("name"),
        parse_address(F.lit(""), F.lit(""), F.lit(""), lines).alias("address"))
    out = address.repair_address(profiles)
    return out.select("doc_id", F.col("address.address_line_1").alias("address_line_1"), F.col("address.full_address").alias("full_address"))


# --- layout -------------------------------------------------------------------------
@query
def layout_rows(spark, d):
    lines = recipes.ocr_lines(spark, d).withColumn("height", F.lit(K.PAGE_HEIGHT))
    return layout.layout_rows(lines).drop("block", "row")


@query
def anchor_match(spark, d):
    lines = recipes.form_lines(spark, d).withColumn("height", F.lit(K.PAGE_HEIGHT))
    return layout.match_anchors(layout.layout_rows(lines)).select("doc_id", "anchor", "cy", F.round("score", 6).alias("score"))


@query
def document_anchors(spark, d):
    lines = recipes.labelled_lines(spark, d).withColumn("height", F.lit(K.PAGE_HEIGHT))
    return layout.match_anchors(layout.layout_rows(lines)).select("doc_id", "anchor", "cy", F.round("score", 6).alias("score"))


@query
def vertical_fit(spark, d):
    fit = layout.fit_pages(recipes.anchor_points(spark, d))
    return fit.select("doc_id", F.round("scale", 6).alias("scale"), F.round("offset", 4).alias("offset"))


@query
def page_regions(spark, d):
    lines = recipes.form_lines(spark, d)
    blank = lines.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("text")))
    pages = recipes.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    found = layout.page_rois(pages, blank, lines)
    return flat(found.select("doc_id", "dynamic", F.explode("rois").alias("r")).select("doc_id", "dynamic", "r.field", "r.roi"),
                "doc_id", "dynamic", "field", roi=("roi", EDGES))


@query
def region_shift(spark, d):
    k = F.col("o_orderkey")
    fits = recipes.table(spark, d, "orders").select(
        k.alias("doc_id"), ((k % 33 + 240) / 256.0).alias("scale"), ((k % 41) * 4.0 - 80.0).alias("offset"))
    moved = fits.select("doc_id", F.explode(geometry.shifted_rois(
        F.lit(K.PAGE_WIDTH), F.lit(K.PAGE_HEIGHT), F.col("scale"), F.col("offset"))).alias("r"))
    return flat(moved.select("doc_id", "r.field", "r.roi"), "doc_id", "field", roi=("roi", EDGES))


@query
def roi_assign(spark, d):
    return layout.assign_fields(recipes.ocr_lines(spark, d)).select("doc_id", "line_no", "field", "text")


@query
def roi_assign_by_template(spark, d):
    found = templates.assign_by_template(
        recipes.labelled_lines(spark, d), recipes.templated_pages(spark, d), recipes.form_templates(spark, d))
    return flat(found, "doc_id", "line_no", "field", "moved", "text", roi=("roi", EDGES))


@query
def crop_windows(spark, d):
    pages = recipes.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (400 + F.col("o_orderkey") % 500).cast("int").alias("w"), (40 + F.col("o_custkey") % 60).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    every = F.concat(
        F.transform(geometry.named_windows(K.DOB_SEGMENT_WINDOWS, w, h), lambda r: F.struct(r["name"].alias("name"), r["roi"].alias("roi"))),
        F.transform(geometry.named_windows(K.GENDER_WINDOWS, w, h), lambda r: F.struct(r["name"].alias("name"), r["roi"].alias("roi"))),
        F.transform(geometry.named_windows(K.ADDRESS_LINE_WINDOWS, w, h), lambda r: F.struct(F.concat(F.lit("line_"), r["name"].cast("string")).alias("name"), r["roi"].alias("roi"))),
    )
    out = pages.select("doc_id", F.size(geometry.fixed_dob_boxes(w, h)).alias("fixed_boxes"), F.explode(every).alias("r"))
    return flat(out.select("doc_id", "fixed_boxes", "r.name", "r.roi"), "doc_id", "fixed_boxes", "name", roi=("roi", EDGES))


# --- refinement -----------------------------------------------------------------------
@query
def roi_candidates(spark, d):
    regions = recipes.base_regions(spark, d)
    out = geometry.with_candidate_rois(regions, F.col("field"), F.col("roi"), K.PAGE_WIDTH, K.PAGE_HEIGHT)
    out = out.select("doc_id", "field", F.col("roi").alias("base"), F.posexplode("rois").alias("roi_ordinal", "roi")).where("roi is not null")
    out = out.withColumn("distance", F.round(geometry.roi_distance(F.col("roi"), F.col("base")), 9))
    return flat(out, "doc_id", "field", "roi_ordinal", "distance", roi=("roi", EDGES))


@query
def refine_gate(spark, d):
    results = recipes.ocr_lines(spark, d).withColumn("field", recipes.pick(K.ENGINE_FIELDS, F.col("line_no") % 7))
    results = results.select(
        "doc_id", "line_no", "field", F.col("text").alias("raw_text"), text.clean_name(F.col("text")).alias("clean_text"),
        F.col("score").alias("confidence"))
    leaked = refine.with_leakage(results)
    gate = refine.needs_refine(*[F.col(c) for c in ("field", "raw_text", "clean_text", "confidence", "leakage")])
    return leaked.select("doc_id", "line_no", "field", F.round("leakage", 6).alias("leakage"), gate.alias("needs_refine"))


@query
def refine_winner(spark, d):
    out = refine.best_refinement(recipes.refinement_results(spark, d))
    return flat(out, "doc_id", "field", "weak", "raw_text", "clean_text", "confidence", "score", roi=("roi", EDGES))


@query
def refine_rounds(spark, d):
    # the left edge tells items apart that share the ordinal
    regions = recipes.base_regions(spark, d).withColumn("doc_id", F.col("doc_id") * 2048 + F.col("roi.x1"))
    read = recipes.stand_in_reads(regions.select("doc_id", "field", "roi"))
    out = refine.refine_rounds(read, recipes.stand_in_reads, settle, discard=discard)
    return flat(out, "doc_id", "field", "weak", "raw_text", "clean_text", "confidence", roi=("roi", EDGES))


# --- cheques ---------------------------------------------------------------------------
@query
def account_lookup(spark, d):
    found = cheque.look_up_accounts(recipes.case_texts(spark, d), recipes.bank_accounts(spark, d))
    return found.select("case_id", "account_number", "account_holder_name", F.col("account_holder_name").isNotNull().alias("account_valid"))


@query
def account_register(spark, d):
    register, quarantine = cheque.register_accounts(recipes.delivered_accounts(spark, d))
    return register.select("*", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("string").alias("reason")).unionByName(quarantine)


@query
def cheque_from_lines(spark, d):
    return jobs.verify_documents(recipes.case_lines(spark, d), recipes.bank_accounts(spark, d))


@query
def case_assembly(spark, d):
    turns = recipes.table(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"), recipes.pick(cheque.DOCUMENT_TYPES, F.col("turn") % 3).alias("doc_type"),
        F.col("turn").alias("line_no"), "text")
    return cheque.cases_from_lines(turns).select("*", cheque._complete().alias("complete"))


@query
def cheque_decision(spark, d):
    return cheque.verify_cheques(recipes.case_texts(spark, d), recipes.bank_accounts(spark, d))


@query
def verdict_report(spark, d):
    return sinks.verdict_report(cheque_decision(spark, d))


@query
def verdict_response(spark, d):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return cheque_decision(spark, d).select("case_id", sinks.verdict_envelope(at).alias("e")).select(
        "case_id", F.col("e.status").alias("status"), F.col("e.data.validation_details.*"),
        F.col("e.data.final_decision").alias("final_decision"), F.col("e.data.engine_metadata.matching_algorithm").alias("matching_algorithm"),
        sinks.verdict_report_name(F.col("e.data.final_decision")).alias("report_name"))


# --- profiles ---------------------------------------------------------------------------
@query
def review_flags(spark, d):
    return consensus_vote(spark, d).select("doc_id", "field", text.review_flags(F.col("confidence")).alias("f")).select(
        "doc_id", "field", "f.*")


def _profiles(spark, d):
    return profile.assemble_profiles(recipes.profile_results(spark, d))


@query
def profile_assemble(spark, d):
    p = _profiles(spark, d)
    metrics = [
        F.col("confidence_metrics")[f][n].alias(f"{f}_{n}") for f in K.ENGINE_FIELDS for n in ("score_percentage", "needs_review")]
    raws = [F.col("raw_extracted_text")[f].alias(f"{f}_raw") for f in K.ENGINE_FIELDS]
    return p.select(
        "doc_id", "full_name", "dob", "gender", "father_name", "location.*",
        F.col("address_details.raw_text").alias("address_text"),
        *[F.col(f"address_details.{k}").alias(k) for k in profile.ADDRESS_KEYS],
        F.array_join("address_details.lines", "|").alias("lines"), *metrics, *raws)


@query
def profile_projection(spark, d):
    asked = recipes.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        fields.parse_fields(recipes.pick(recipes.PAYLOADS, F.col("o_orderkey") % len(recipes.PAYLOADS)))["fields"].alias("fields"))
    shown = profile.project_profile(_profiles(spark, d).join(asked, "doc_id"), F.col("fields"))
    return shown.select(
        "doc_id", "full_name", "dob", "gender", "father_name", F.col("location.pincode").alias("pincode"),
        F.col("address_details.city").alias("city"),
        F.array_join(F.array_sort(F.map_keys("confidence_metrics")), ",").alias("metric_fields"),
        F.array_join(F.array_sort(F.map_keys("raw_extracted_text")), ",").alias("raw_fields"))


@query
def form_profiles(spark, d):
    p = jobs.extract_profiles(**recipes.form_reads(spark, d))
    return p.select(
        "doc_id", "full_name", "father_name", "dob", "gender", "location.*", F.col("confidence_metrics")["name"]["score_percentage"].alias("name_score"),
        F.array_join(F.array_sort(F.map_keys("confidence_metrics")), ",").alias("metric_fields"))


@query
def requested_profiles(spark, d):
    given = recipes.form_reads(spark, d)
    asked = fields.parse_fields(recipes.pick(recipes.PAYLOADS, F.col("doc_id") % len(recipes.PAYLOADS)))
    # exploded, the parsed request is a column of its own; else each use of it would parse again
    requests = given.pop("documents").select("doc_id", F.explode(F.array(asked["fields"])).alias("fields")).where("fields is not null")
    p = jobs.requested_profiles(requests, **given)
    return p.select(
        "doc_id", "full_name", "father_name", "dob", "gender", F.col("location.state").alias("state"), F.col("location.pincode").alias("pincode"),
        F.array_join(F.array_sort(F.map_keys("confidence_metrics")), ",").alias("metric_fields"),
        F.array_join(F.array_sort(F.map_keys("raw_extracted_text")), ",").alias("raw_fields"))


@query
def report_rows(spark, d):
    return sinks.profile_report(_profiles(spark, d))


@query
def artefact_links(spark, d):
    # ids beyond 32 bits, so that a cut would show
    far = _profiles(spark, d).withColumn("doc_id", F.col("doc_id").cast("long") + F.lit(1 << 32))
    linked = sinks.with_artefact_links(far).select(
        "doc_id", "image_url", sinks.profile_report_name(F.col("full_name")).alias("report_name"), F.explode("debug_crops").alias("field", "url"))
    return linked


@query
def profile_read_back(spark, d):
    p = _profiles(spark, d)
    k = F.col("doc_id")
    body = F.struct(*[c for c in p.columns if c != "doc_id"])
    edited = p.select("doc_id", F.when(k % 5 == 0, F.to_json(F.struct(body.alias("data"))))
                      .when(k % 5 == 1, F.to_json(F.struct(body.alias("profile"))))
                      .when(k % 5 == 2, F.to_json(body))
                      .when(k % 5 == 3, F.lit('{"data": [1]}')).otherwise(F.lit("{broken")).alias("json"))
    return sinks.read_back(edited).select(
        "doc_id", F.col("profile.full_name").alias("full_name"), F.col("profile.location.state").alias("state"),
        F.col("profile.confidence_metrics")["pin"]["needs_review"].alias("pin_review"), "error")


# --- templates ---------------------------------------------------------------------------
@query
def calibration_boxes(spark, d):
    return calibration.calibrated_regions(recipes.drag_events(spark, d))


@query
def roi_merge(spark, d):
    return recipes.user_templates(spark, d)
