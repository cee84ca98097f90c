"""What a page asks for: submitted forms, chosen links, request and console logs, budgets, scores of runs."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlencode, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import dom, extract
from webloom.functions.selectors import first
from webloom.functions.urls import resolve
from webloom.plans.nodes import per_page

#: Uploads of a multipart form. Fixed values.
MOST_FILES, MOST_FILE_BYTES = 8, 4 << 20
_UNSENT = frozenset("submit reset button image file".split())
#: Marks that a framework leaves in a page, the surer first. Fixed values.
FRAMEWORKS = {
    "react": "[data-reactroot], #__next, script#__NEXT_DATA__",
    "vue": "[data-v-app], [data-server-rendered]",
    "svelte": "[class*='svelte-']",
}


def _chosen(select: dom.Element) -> str:
    for option in select.elements():
        if option.tag == "option" and "selected" in option.attrs:
            return option.get("value") if "value" in option.attrs else dom.collapsed(option)
    return ""


def successful(form: dom.Element) -> list[tuple[str, str]]:
    """Names and values that a form sends, in document order; buttons, files, what is disabled or unchecked are not sent."""
    sent = []
    for e in form.elements():
        kind = e.get("type").strip().lower()
        if e.tag not in ("input", "select", "textarea") or not e.get("name") or "disabled" in e.attrs or (e.tag == "input" and kind in _UNSENT):
            continue
        if e.tag == "input" and kind in ("checkbox", "radio"):
            if "checked" in e.attrs:
                sent.append((e.get("name"), e.get("value") or "on"))
        else:
            sent.append((e.get("name"), _chosen(e) if e.tag == "select" else "".join(dom.texts(e)) if e.tag == "textarea" else e.get("value")))
    return sent


def form_requests(pages: DataFrame, name: str = "", index: int | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """The request of one form a page: method, target, body and multipart.

    The form is the one with that id or name, else the one at ``index``, else the only one; ``error`` says why there is none. The
    caller's values replace the page's own. GET carries them in the query, in place of the action's own.
    """

    def kernel(root: dom.Element, url: str) -> list[dict]:
        forms = [e for e in root.elements() if e.tag == "form"]
        if name:
            fits = [f for f in forms if name in (f.get("id"), f.get("name"))]
        elif index is not None:
            fits = forms[index : index + 1] if index >= 0 else []
        else:
            fits = forms if len(forms) == 1 else []
        if not fits:
            return [{"error": "no form" if not forms else "no such form" if name or index is not None else f"{len(forms)} forms, name one"}]
        form, given = fits[0], values or {}
        pairs = [p for p in successful(form) if p[0] not in given] + list(given.items())
        method = form.get("method").strip().upper()
        method = method if method == "POST" else "GET"
        target, body = resolve(extract.base_url(root, url), form.get("action")) or url, urlencode(sorted(pairs, key=lambda p: p[0]))
        if method == "GET":
            target, body = urlunsplit((*urlsplit(target)[:3], body, "")), ""
        return [{"method": method, "target": target, "body": body, "multipart": form.get("enctype").strip().lower() == "multipart/form-data"}]

    return per_page(pages, kernel, "method string, target string, body string, multipart boolean, error string")


def upload_error(files: Column) -> Column:
    """Null, or why files (array of struct with ``size``) are not sent."""
    total = F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["size"].cast("long"), F.lit(0)))
    return F.when(F.size(files) > MOST_FILES, F.lit(f"more than {MOST_FILES} files")).when(total > MOST_FILE_BYTES, F.lit(f"files exceed {MOST_FILE_BYTES} bytes"))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def uploaded(files: Column, opened: Callable[[Column], Column] | None = None) -> Column:
    """struct(error, parts) of the files of a multipart form, as a column: array of struct(field, filename, mime, content, content_base64) in, array of struct(field, filename, mime, data) out.

    The first error in order of files counts: too many files, a file without a field, one with both contents, one whose base64
    can't be read, and the file with which all are too large together. A null list is empty. ``opened`` makes such a struct of
    what stands for a file in the array; each file is opened once, and none of a form with too many.
    """
    given = F.coalesce(files, F.slice(files, 1, 0))
    at = lambda i: F.concat(F.lit("files["), i.cast("string"), F.lit("]: "))

    def part(f: Column) -> Column:
        text, coded = F.coalesce(f["content"], F.lit("")), F.coalesce(f["content_base64"], F.lit(""))
        data = F.when(coded != "", F.try_to_binary(coded, F.lit("base64"))).otherwise(text.cast("binary"))

        def read(d: Column) -> Column:
            bad = (
                F.when(F.trim(F.coalesce(f["field"], F.lit(""))) == "", "field is required").when((text != "") & (coded != ""), "give content or content_base64, not both")
                .when((coded != "") & d.isNull(), "invalid base64")
            )
            return F.struct(f["field"].alias("field"), F.coalesce(F.nullif(f["filename"], F.lit("")), F.lit("upload.bin")).alias("filename"), f["mime"].alias("mime"), d.alias("data"), bad.alias("bad"))

        return _bound(data, read)

    # one pass: the first error, and bytes so far
    start = F.struct(F.lit(None).cast("string").alias("e"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"))

    def step(a: Column, p: Column) -> Column:
        n = a["n"] + F.coalesce(F.octet_length(p["data"]), F.lit(0)).cast("long")
        own = F.coalesce(F.concat(at(a["i"]), p["bad"]), F.when(n > MOST_FILE_BYTES, F.lit(f"upload too large: over {MOST_FILE_BYTES} bytes total")))
        return F.struct(F.coalesce(a["e"], own).alias("e"), n.alias("n"), (a["i"] + 1).alias("i"))

    def told(parts: Column) -> Column:
        many = F.when(F.size(given) > MOST_FILES, F.concat(F.lit("too many files: "), F.size(given), F.lit(f" (max {MOST_FILES})")))
        sent = lambda p: F.struct(*[p[c].alias(c) for c in ("field", "filename", "mime", "data")])
        return _bound(F.coalesce(many, F.aggregate(parts, start, step)["e"]), lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.transform(parts, sent)).alias("parts")))

    return _bound(F.when(F.size(given) <= MOST_FILES, F.transform(given, lambda f: _bound(opened(f), part) if opened else part(f))), told)


def pick_link(found: DataFrame, index: int | None = None, match: str = "") -> DataFrame:
    """One link a page: the one at ``index`` (from 0, in document order), or the first whose text or address holds ``match``."""
    rows = found
    if match:
        q = F.lit(match.lower())
        rows = found.where(F.contains(F.lower("text"), q) | F.contains(F.lower("href"), q))
    place = 0 if match or index is None else index
    w = Window.partitionBy("page_id").orderBy("pre")
    return rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") == place + 1).drop("_at")


def frameworks(pages: DataFrame) -> DataFrame:
    """react, vue, svelte or "" by what the markup shows."""
    return per_page(pages, lambda r, u: [{"framework": next((n for n, css in FRAMEWORKS.items() if first(r, css)), "")}], "framework string")


def of_types(log: DataFrame, types: list[str], column: str = "type") -> DataFrame:
    """Requests of these types, whatever the case; no type is all of them."""
    wanted = sorted({t.strip().lower() for t in types} - {""})
    return log.where(F.lower(column).isin(*wanted)) if wanted else log


def of_level(log: DataFrame, level: str = "", column: str = "level") -> DataFrame:
    return log.where(F.col(column) == level) if level else log


def within_budget(requests: DataFrame, group: list[str], order: list[str], size: str, most_bytes: int = 0, most_requests: int = 0) -> DataFrame:
    """Requests with ``allowed``: bytes are counted once a request is through, so the one that crosses the budget passes; 0 is no limit.

    Sizes are not negative and a denied request adds none; as sums only grow, all after the first denied one are denied as well, and
    plain running sums tell it. What is denied for bytes takes no place in the count.
    """
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent, asked = F.coalesce(F.sum(size).over(before), F.lit(0)), F.count(F.lit(1)).over(before)
    fits = (F.lit(most_bytes <= 0) | (spent < most_bytes)) & (F.lit(most_requests <= 0) | (asked < most_requests))
    return requests.withColumn("allowed", fits)


def offered_tools(tools: Column, allow: Column, deny: Column, missing: Column, presets: dict[str, list[str]] | None = None) -> Column:
    """Tools of an allow list (empty: all) without a deny list and without those whose capability is missing, sorted; presets stand for several."""

    def expanded(names: Column) -> Column:
        out = names
        for preset, members in (presets or {}).items():
            out = F.when(F.array_contains(names, preset), F.array_union(out, F.array(*map(F.lit, members)))).otherwise(out)
        return out

    kept = F.when(F.size(allow) > 0, F.array_intersect(tools, expanded(allow))).otherwise(tools)
    return F.array_sort(F.array_except(F.array_except(kept, expanded(deny)), missing))


def scorecard(cases: DataFrame, floor: float) -> DataFrame:
    """One row from (name, mean, passed, must_pass, run_error): overall mean, cases passed, failures and whether the gate opens."""
    failed = F.col("run_error").isNotNull() | (F.col("must_pass") & ~F.col("passed"))
    ok = F.col("passed") & F.col("run_error").isNull()
    out = cases.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall"), F.count_if(ok).alias("passed"), F.count_if(failed).alias("failures"))
    return out.withColumn("gate", (F.col("failures") == 0) & (F.col("overall") >= floor))
