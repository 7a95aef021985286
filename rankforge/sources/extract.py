"""Pages to typed rows: classification and extraction as built-in string functions over a table of pages.

A page is cut at markers, the opening tags of its sections, and values are read from attributes and from the texts
between tags. Blanks between tags are dropped first, so that a marker may span two tags.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalars import is_duel, parse_list_date, parse_ordinal_date, unescape

# The classes and marks of the page format, and where brackets are hosted.
MATCH = '<div class="match">'
MATCH_ENDS = ("<!--posthits=", '<div class="sharelinks">')
PLAYER = '<div class="m_name_flag">'
RESULT = '<div class="res">'
TITLE = '<div class="title">'
MAPS = '<div class="m_detailed">'
VOD = '<div class="match_vod">'
EMBED = '<div class="videoplaceholder'
POST = '<div id="postinnercontent">'
SIDEBAR = '<div class="sidebar'
ICON = '<i class="pfcat-'
TIERS = ("premier", "major", "minor")
PROVIDERS = (
    ("toornament", r"(?i)play\.toornament\.com/[a-z_]+/tournaments/(\d+)"),
    ("shambler", r"(?i)shambler\.site/(?:[a-z0-9_-]+/)*brackets\.php\?cup=(\d+)"),
    ("egb", r"(?i)(?:egb\.com|egb\.net|egabetz\.com|egabe\.online)/cup#/t/([a-z0-9_-]+)"),
    ("kuachi", r"(?i)kuachi\.gg/cups/([0-9a-f-]{36}/stage/\d+)"),
)


def tight(html: Column) -> Column:
    """A page without blanks between its tags."""
    return F.regexp_replace(html, r">\s+<", "><")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cut(x: Column, *marks: str, limit: int = -1) -> Column:
    """What stands between the marks."""
    return F.split(x, "|".join(f"\\Q{m}\\E" for m in marks), limit)


def before(x: Column, mark: str) -> Column:
    """What stands before the first mark; all without one."""
    return F.substring_index(x, mark, 1)


def after(x: Column, mark: str) -> Column:
    """What stands behind the first mark; null without one."""
    return F.get(cut(x, mark, limit=2), F.lit(1))


def parts(x: Column, mark: str) -> Column:
    """What follows each mark, up to the next one."""
    return F.filter(cut(F.coalesce(x, F.lit("")), mark), lambda _, i: i > 0)


def attribute(x: Column, name: str) -> Column:
    """The value of the first attribute of a name; null without one or if it is empty."""
    return F.nullif(before(after(x, f'{name}="'), '"'), F.lit(""))


def texts(x: Column) -> Column:
    """The texts between tags that are not blank, trimmed."""
    return F.filter(F.transform(F.split(x, "<"), lambda t: F.trim(F.substring_index(t, ">", -1))), lambda t: t != "")


def number(x: Column, kind: str = "int") -> Column:
    return F.trim(x).try_cast(kind)


def titled(area: Column, label: str) -> Column:
    """The texts of the section under a title."""
    return texts(before(before(after(area, f"{TITLE}{label}</div>"), TITLE), "</div></div>"))


def link(x: Column, kind: str) -> Column:
    """The path of the first link to a page of a kind, cut at its slashes: the id comes first."""
    return F.split(before(after(x, f'href="/{kind}/'), '"'), "/")


def content(html: Column) -> Column:
    """The match area of a page; null if it has none or does not end."""

    def ended(x: Column) -> Column:
        ends = reduce(Column.__or__, [F.contains(x, F.lit(m)) for m in MATCH_ENDS])
        return F.when(ends, reduce(before, MATCH_ENDS, x))

    return let(after(html, MATCH), ended)


def body(html: Column) -> Column:
    return F.coalesce(before(after(html, POST), f"</div>{SIDEBAR}"), html)


def player_blocks(area: Column) -> Column:
    """The blocks of players that link to a player's page."""
    blocks = F.transform(parts(area, PLAYER), lambda b: before(b, "</div></div>"))
    return F.filter(blocks, lambda b: number(F.get(link(b, "player"), F.lit(0)), "long").isNotNull() & (F.size(link(b, "player")) >= 4))


def result_cells(area: Column) -> Column:
    """(score, won) of the cells that hold a whole number."""
    cells = F.transform(parts(area, RESULT), lambda c: before(c, "</div></div>"))
    read = F.transform(cells, lambda c: F.struct(number(F.substring_index(c, ">", -1)).alias("score"), F.contains(before(c, ">"), F.lit('class="win"')).alias("won")))
    return F.filter(read, lambda c: c["score"].isNotNull())


def page_title(html: Column) -> Column:
    return F.trim(F.coalesce(before(after(html, "<title>"), "</title>"), F.lit("")))


def opened(html: Column) -> Column:
    """A page read once: its kind (parent index, tournament, vod, match, or why it gives nothing), the page without
    blanks between its tags, and of the match area the whole, the description, players and results."""
    empty = F.lit(None).cast("string")
    nothing = {"area": empty, "about": F.lit(None).cast("array<string>"), "players": F.lit(None).cast("array<string>"), "results": F.lit(None).cast("array<struct<score:int,won:boolean>>")}
    row = lambda kind, page, read: F.struct(kind.alias("kind"), page.alias("page"), *[c.alias(n) for n, c in read.items()])

    def by_area(page: Column, area: Column) -> Column:
        read = F.struct(area.alias("area"), titled(area, "Description").alias("about"), player_blocks(area).alias("players"), result_cells(area).alias("results"))
        return let(read, lambda r: row(by_format(area, F.lower(F.coalesce(F.get(r["about"], F.lit(1)), F.lit(""))), r), page, {n: r[n] for n in nothing}))

    def by_format(area: Column, fmt: Column, r: Column) -> Column:
        return (
            F.when(is_duel(fmt) & (F.size(r["players"]) >= 2) & (F.size(r["results"]) >= 2), "match")
            .when(html.contains("postvods") | html.contains("videoplaceholder"), "vod")
            .when(F.lower(page_title(html)).startswith("deleted"), "invalid")
            .when(~html.contains(MATCH), "not a match")
            .when((fmt != "") & ~fmt.contains("duel") & ~fmt.contains("1v1"), "team format")
            .when(area.isNotNull() & (F.size(r["results"]) < 2), "not played")
            .otherwise("parse error")
        )

    def by_kind(page: Column) -> Column:
        events = F.filter(parts(body(page), TITLE + ICON), lambda t: F.startswith(after(t, "</i>"), F.lit('<a href="/post/')))
        return (
            F.when(F.trim(html) == "", row(F.lit("invalid"), page, nothing))
            .when(F.contains(page, F.lit(TITLE + ICON)) & (F.size(events) >= 2), row(F.lit("parent index"), page, nothing))
            .when(html.contains("postinnercontent") & html.contains("tour_info"), row(F.lit("tournament"), page, nothing))
            .otherwise(let(content(page), lambda area: by_area(page, area)))
        )

    return F.when(html.isNull(), row(F.lit("invalid"), empty, nothing)).otherwise(let(tight(html), by_kind))


def page_class(html: Column) -> Column:
    """parent index, tournament, vod, match, or why a page gives nothing."""
    return opened(html)["kind"]


def valid_page(html: Column, generic_title: str) -> Column:
    """Whether a page is more than the site's generic one."""
    return page_title(html) != generic_title


def decide_winner(marker: Column, p1: Column, p2: Column, s1: Column, s2: Column) -> tuple[Column, Column, Column]:
    """Winner id and both scores: the page's mark decides, else the score; a marked even score becomes 1:0."""
    winner = F.when(marker == 1, p1).when(marker == 2, p2).when(s1 > s2, p1).when(s2 > s1, p2)
    even = (s1 == s2) & winner.isNotNull()
    return winner, F.when(even, (winner == p1).cast("int")).otherwise(s1), F.when(even, (winner == p2).cast("int")).otherwise(s2)


def matches(pages: DataFrame) -> DataFrame:
    """A row for each page of a played duel (post_id, raw_html)."""
    x = played(pages)
    if "area" not in x.columns:
        x = x.withColumn("area", content(F.col("page")))
        x = x.withColumns({"about": titled(F.col("area"), "Description"), "players": player_blocks(F.col("area")), "results": result_cells(F.col("area"))})
    x = x.withColumnsRenamed({"area": "c", "players": "b", "results": "r"})
    c = F.col("c")
    x = x.withColumns({"cup": titled(c, "Tournament"), "day": titled(c, "Date"), "links": F.transform(parts(c, 'href="/player/'), lambda p: before(p, '"'))})
    won = lambda i: F.col("r")[i]["won"]
    marker = F.when(won(0) & ~won(1), 1).when(won(1) & ~won(0), 2).otherwise(0)
    block = lambda i: F.col("b")[i]
    name = lambda i: unescape(F.get(texts(before(after(after(block(i), 'href="/player/'), ">"), "</a>")), F.lit(0)))
    flag = lambda i: F.lower(F.nullif(F.regexp_extract(after(block(i), "s_flag-"), "^[A-Za-z0-9]*", 0), F.lit("")))
    x = x.withColumns({"p1": number(link(block(0), "player")[0], "long"), "p2": number(link(block(1), "player")[0], "long")})
    winner, s1, s2 = decide_winner(marker, F.col("p1"), F.col("p2"), F.col("r")[0]["score"], F.col("r")[1]["score"])
    icon = number(before(after(c, 'class="pfcat pfcat-'), '"'))
    linked = F.filter(F.transform("links", lambda p: number(F.get(F.split(p, "/"), F.lit(2)))), lambda v: v > 0)
    text = lambda col, i: F.get(F.col(col), F.lit(i))
    section = after(c, f"{TITLE}Tournament</div>")
    return x.select(
        F.col("post_id").alias("match_id"),
        F.col("p1").alias("player1_id"),
        F.col("p2").alias("player2_id"),
        name(0).alias("player1_name"),
        name(1).alias("player2_name"),
        flag(0).alias("player1_country"),
        flag(1).alias("player2_country"),
        s1.alias("player1_score"),
        s2.alias("player2_score"),
        winner.alias("winner_id"),
        text("about", 0).alias("game_name"),
        F.coalesce(F.nullif(icon, F.lit(0)), F.get(linked, F.lit(0))).alias("game_id"),
        text("about", 1).alias("match_format"),
        number(F.get(link(section, "post"), F.lit(0)), "long").alias("tournament_id"),
        unescape(text("cup", 0)).alias("tournament_name"),
        unescape(text("cup", 1)).alias("stage_name"),
        parse_ordinal_date(text("day", 1), text("day", 0)).alias("played_at"),
    )


def classified(pages: DataFrame) -> DataFrame:
    """pages with _kind, their class, so that several extractions work it out once."""
    return pages.withColumn("_kind", page_class(F.col("raw_html")))


def kind_of(pages: DataFrame) -> Column:
    return F.col("_kind") if "_kind" in pages.columns else page_class(F.col("raw_html"))


def of_kind(pages: DataFrame, kind: str) -> DataFrame:
    """(post_id, raw_html, page, ...) of the pages of a kind; those not classified come with all that opened reads.

    Pages are opened in a generator, which no filter passes, so that each is written and read once.
    """
    if "_kind" in pages.columns:
        return pages.filter(F.col("_kind") == kind).withColumn("page", tight(F.col("raw_html")))
    return pages.select("post_id", "raw_html", F.explode(F.array(opened(F.col("raw_html")))).alias("_p")).filter(F.col("_p.kind") == kind).select("post_id", "raw_html", "_p.*")


def played(pages: DataFrame) -> DataFrame:
    """The pages that give a match; a page that is rejected gives no maps or recordings either."""
    return of_kind(pages, "match")


def match_maps(pages: DataFrame) -> DataFrame:
    """The maps of matches, numbered by those with two scores."""
    maps = before(after(F.col("page"), MAPS), "<script")
    rows = played(pages).select(F.col("post_id").alias("match_id"), F.posexplode(parts(maps, "<tr>")).alias("map_index", "r"))
    scores = F.transform(parts(F.col("r"), 'class="score_value'), lambda c: number(before(after(c, ">"), "<")))
    rows = rows.filter(F.contains("r", F.lit('class="map"'))).withColumn("s", F.filter(scores, lambda v: v.isNotNull())).filter(F.size("s") >= 2)
    again = Window.partitionBy("match_id").orderBy("map_index")
    image = attribute(F.col("r"), "data-image")
    return rows.select(
        "match_id",
        (F.row_number().over(again) - 1).alias("map_index"),
        image_id(image).alias("map_id"),
        F.coalesce(attribute(F.col("r"), "data-name"), F.lit("?")).alias("map_name"),
        image.alias("image"),
        F.col("s")[0].alias("player1_score"),
        F.col("s")[1].alias("player2_score"),
    )


def image_id(path: Column) -> Column:
    """The map that an image is of: its file is named by the map's number."""
    return number(before(after(path, "/maps/"), "_"))


def match_vods(pages: DataFrame) -> DataFrame:
    """The recordings that pages of matches link to."""
    rows = played(pages).select(F.col("post_id").alias("match_id"), F.posexplode(F.filter(parts(F.col("page"), VOD), lambda v: F.contains(v, F.lit('href="/post/')))).alias("vod_index", "r"))
    anchor = after(after(F.col("r"), 'href="/post/'), ">")
    return rows.select(
        "match_id",
        "vod_index",
        number(F.get(link(F.col("r"), "post"), F.lit(0)), "long").alias("vod_post_id"),
        F.trim(unescape(before(anchor, "</a>"))).alias("label"),
        F.trim(unescape(after(before(after(anchor, "</a>"), "<"), "-"))).alias("caster"),
    )


def vod_embeds(pages: DataFrame) -> DataFrame:
    tag = before(after(F.col("raw_html"), EMBED), ">")
    rows = pages.select(F.col("post_id").alias("vod_post_id"), F.lower(F.trim(attribute(tag, "data-type"))).alias("platform"), F.trim(attribute(tag, "data-id")).alias("video_id"))
    return rows.filter("platform is not null and video_id is not null")


def attach_embeds(vods: DataFrame, embeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vods with the embeds of their pages, known ones kept; and embeds that no vod links to yet."""
    new = embeds.select("vod_post_id", F.col("platform").alias("_p"), F.col("video_id").alias("_v"))
    out = vods.join(new, "vod_post_id", "left").withColumn("platform", F.coalesce("_p", "platform")).withColumn("video_id", F.coalesce("_v", "video_id")).drop("_p", "_v")
    return out, embeds.join(vods.select("vod_post_id"), "vod_post_id", "left_anti")


def tournaments(pages: DataFrame, games: DataFrame) -> DataFrame:
    """A row for each tournament page; the game by its title, else by its category icon."""
    x = of_kind(pages, "tournament").withColumn("b", body(F.col("page")))
    b = F.col("b")
    field: Callable[[str], Column] = lambda label: F.nullif(F.trim(unescape(F.array_join(texts(before(after(b, f'<div class="tc_title">{label}</div>'), "</div>")), " "))), F.lit(""))
    x = x.withColumns({"icon": after(b, TITLE + ICON), "when": field("Schedule")})
    heading = F.trim(before(after(F.col("icon"), "</i>"), "<"))
    tier = F.lower(F.element_at(F.split(heading, r"\s+"), 1))
    named = F.when(tier.isin(*TIERS), F.trim(F.substr(heading, F.length(tier) + 1))).otherwise(heading)
    day = F.array_join(F.slice(F.split("when", r"[\s\u2013-]+"), 1, 3), " ")
    hours = F.regexp_extract_all("when", F.lit(r"\d{1,2}:\d{2}"), F.lit(0))
    time = lambda i: F.try_to_timestamp(F.concat_ws(" ", day, F.coalesce(F.get(hours, F.lit(i)), F.get(hours, F.lit(0)))), F.lit("d MMM yyyy H:mm"))
    x = x.select(
        F.col("post_id").alias("tournament_id"),
        unescape(F.get(texts(before(after(F.col("page"), '<h1 class="posttitle">'), "</h1>")), F.lit(0))).alias("name"),
        F.when(tier.isin(*TIERS), tier).otherwise("minor").alias("tier"),
        F.nullif(F.trim(F.element_at(F.split(named, r"\s+[\u2013-]"), 1)), F.lit("")).alias("title_game"),
        number(before(F.col("icon"), '"')).alias("game_id"),
        field("Prizemoney").alias("prize_money"),
        field("Tourney format").alias("tourney_format"),
        field("Match format").alias("match_format"),
        F.when(F.size(hours) > 0, time(0)).alias("schedule_start"),
        F.when(F.size(hours) > 0, time(1)).alias("schedule_end"),
        F.filter(F.transform(previews(b), lambda m: m["name"]), lambda n: n.isNotNull()).alias("maplist"),
    )
    return x.join(games.select("game_id", F.col("name").alias("_game")), "game_id", "left").withColumn("game", F.coalesce("title_game", "_game")).drop("_game", "title_game")


def previews(html: Column) -> Column:
    """(name, image) of the maps that a page shows."""
    return F.transform(parts(html, '<span class="map_preview"'), lambda m: let(before(m, ">"), lambda tag: F.struct(attribute(tag, "data-name").alias("name"), attribute(tag, "data-image").alias("image"))))


def listed_maps(pages: DataFrame) -> DataFrame:
    """(tournament_id, place, map_id, name, image) of the maps on tournament pages that have an id, in order."""
    rows = pages.select(F.col("post_id").alias("tournament_id"), F.posexplode(previews(tight(F.col("raw_html")))).alias("place", "m")).select("tournament_id", "place", image_id(F.col("m.image")).alias("map_id"), "m.name", "m.image")
    return rows.filter("map_id is not null and name is not null")


def standings(pages: DataFrame) -> DataFrame:
    """Rows of all ranking tables, each with the category of the sub-event that it stands under.

    A page without titled sub-events is one block.
    """
    whole = body(tight(F.col("raw_html")))
    events = F.transform(parts(whole, TITLE + ICON), lambda e: F.struct(number(before(e, '"')).alias("cat"), e.alias("block")))
    plain = F.array(F.struct(F.lit(None).cast("int").alias("cat"), whole.alias("block")))
    blocks = pages.select(F.col("post_id").alias("tournament_id"), F.posexplode(F.when(F.size(events) > 0, events).otherwise(plain)).alias("block_no", "e")).select("tournament_id", "block_no", "e.*")
    rows = blocks.select("tournament_id", "block_no", "cat", "block", F.posexplode(parts(F.col("block"), '<td class="position">')).alias("row_no", "r"))
    profile = after(F.col("r"), '<a class="profile" href="/player/')
    rows = rows.withColumns({"id": number(before(before(profile, '"'), "/"), "long"), "who": F.get(texts(before(after(profile, ">"), "</a>")), F.lit(0))}).filter("id is not null and who is not null")
    heading = F.trim(unescape(before(after(after(F.col("block"), "</i><a href="), ">"), "</a>")))
    title = F.trim(F.coalesce(after(heading, "-"), heading, F.lit("")))
    return rows.select("tournament_id", "block_no", "row_no", F.trim(before(F.col("r"), "<")).alias("position"), F.col("id").alias("player_id"), F.col("who").alias("player_name"), F.trim(F.coalesce(before(after(F.col("r"), '<td class="prizemoney">'), "<"), F.lit(""))).alias("prize"), title.alias("game"), F.coalesce("cat", F.lit(0)).alias("game_category_id"))


def listed_matches(pages: DataFrame) -> DataFrame:
    """(page, match_id, played_at) from listing pages (page, html)."""
    rows = pages.select("page", F.explode(parts(F.col("html"), 'href="/post/')).alias("r")).filter(F.contains(before(F.col("r"), ">"), F.lit('class="listmatch')))
    rows = rows.select("page", number(before(F.col("r"), "/"), "long").alias("match_id"), parse_list_date(F.trim(attribute(F.col("r"), "title"))).alias("played_at"))
    return rows.filter("match_id is not null and played_at is not null")


def has_next(html: Column) -> Column:
    """Whether the link to the next page is one to a numbered page."""
    return F.contains(html, F.lit(">next page</a>")) & F.contains(F.substring_index(before(html, ">next page</a>"), "href=", -1), F.lit("page="))


def register(candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """Candidates (match_id, played_at) not among posts, once each, as discovered posts."""
    new = candidates.groupBy(F.col("match_id").alias("post_id")).agg(F.min("played_at").alias("sort_time")).join(posts.select("post_id"), "post_id", "left_anti")
    return new.select("post_id", F.lit(None).cast("string").alias("raw_html"), F.lit("discovered").alias("status"), F.lit(None).cast("string").alias("reason"), "sort_time")


def progress(listed: DataFrame, posts: DataFrame, run: int = 3) -> DataFrame:
    """Per listing page: new and known ids, and whether discovery had caught up by then: run known pages on end."""
    known = posts.select(F.col("post_id").alias("match_id"), F.lit(1).alias("k")).distinct()
    per = listed.join(known, "match_id", "left").groupBy("page").agg(F.count_if(F.col("k").isNull()).alias("new"), F.count_if(F.col("k").isNotNull()).alias("known"))
    order = Window.orderBy("page")  # a row a page
    last = F.sum((F.col("new") == 0).cast("int")).over(order.rowsBetween(1 - run, 0))
    return per.withColumn("caught_up", F.max((last == run).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def due(posts: DataFrame, now: Column) -> DataFrame:
    return posts.filter((F.col("status") == "skipped") & (F.col("reason") == "not played") & (F.col("sort_time") <= now))


def walls(posts: DataFrame, n: int) -> DataFrame:
    """Runs of at least n invalid posts of consecutive ids.

    Ids fall in ranges that are ordered apart; a run is cut at the edges of its range, and its pieces are joined.
    """
    bad = posts.filter("status = 'skipped' and reason = 'invalid'").select("post_id", F.floor(F.col("post_id") / 100_000).alias("range"))
    island = F.col("post_id") - F.row_number().over(Window.partitionBy("range").orderBy("post_id"))
    pieces = bad.withColumn("i", island).groupBy("range", "i").agg(F.min("post_id").alias("lo"), F.max("post_id").alias("hi"))
    order = Window.orderBy("lo")  # of pieces, not of posts
    start = F.when(F.col("lo") - 1 == F.lag("hi").over(order), 0).otherwise(1)
    runs = pieces.withColumn("s", start).withColumn("run", F.sum("s").over(order)).groupBy("run").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"))
    return runs.withColumn("length", F.col("last_id") - F.col("first_id") + 1).filter(F.col("length") >= n).select("first_id", "last_id", "length")


def pending_vods(vods: DataFrame, posts: DataFrame) -> DataFrame:
    return vods.select(F.col("vod_post_id").alias("post_id")).distinct().join(posts.select("post_id"), "post_id", "left_anti")


def bracket_source(html: Column) -> tuple[Column, Column]:
    """Provider and reference of the first bracket link, providers in order."""
    kind, ref = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(PROVIDERS):
        hit = F.rlike(html, F.lit(pattern))
        kind, ref = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract(html, pattern, 1)).otherwise(ref)
    return kind, ref


def needs_bracket(tournaments: DataFrame, stored: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """Tournaments (tournament_id, source) whose bracket is missing, empty or older than so many days."""
    rows = tournaments.filter("source is not null").join(stored.select("tournament_id", "matches", "fetched_at"), "tournament_id", "left")
    old = F.col("fetched_at") < now - F.make_interval(days=F.lit(days))
    return rows.filter(F.col("matches").isNull() | (F.col("matches") == 0) | old).select("tournament_id", "source")


def latest_columns(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the last value of each column that is not null, with its time as <column>_at.

    rows have a version, the struct at, or a struct for each column, <column>_at. What comes out can go in again
    with more rows, so rows may come in any order and more than once. Equal versions take the greater value.
    """
    version = lambda c: f"{c}_at" if f"{c}_at" in rows.columns else "at"
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(version(c)).alias("at"), F.col(c).alias("value")))).alias(c)
    out = rows.groupBy(*keys).agg(*[last(c) for c in columns])
    return out.select(*keys, *[F.col(f"{c}.value").alias(c) for c in columns], *[F.col(f"{c}.at").alias(f"{c}_at") for c in columns])


def dimension_players(matches: DataFrame) -> DataFrame:
    """The last name and country of each player by match time; unnamed and unnumbered players are left out."""
    return latest_columns(player_facts(matches), ["player_id"], ["name", "country"]).filter("name is not null").select("player_id", "name", "country")


def player_facts(matches: DataFrame) -> DataFrame:
    """(player_id, name, country, at) of both sides of parsed matches."""
    side = lambda i: F.struct(F.col(f"player{i}_id").alias("player_id"), F.col(f"player{i}_name").alias("name"), F.col(f"player{i}_country").alias("country"))
    rows = matches.select(F.struct("played_at", "match_id").alias("at"), F.explode(F.array(side(1), side(2))).alias("p")).select("at", "p.*")
    return rows.filter("player_id > 0 and name <> '' and name <> '?'")


def game_facts(matches: DataFrame) -> DataFrame:
    """(game_id, name, at) of parsed matches whose page shows the category."""
    return matches.filter("game_id > 0").select("game_id", F.nullif("game_name", F.lit("")).alias("name"), F.struct("played_at", "match_id").alias("at"))


def map_facts(maps: DataFrame, matches: DataFrame) -> DataFrame:
    """(map_id, name, image, at) of parsed maps with an id and a name."""
    rows = maps.filter("map_id > 0 and map_name <> '' and map_name <> '?'").select("match_id", "map_id", F.col("map_name").alias("name"), F.nullif("image", F.lit("")).alias("image"))
    return rows.join(matches.select("match_id", "played_at"), "match_id").select("map_id", "name", "image", F.struct("played_at", "match_id").alias("at"))


#: What a tournament's own page tells of it; a match page tells its name alone.
TOURNAMENT_COLUMNS = ["name", "tier", "game", "game_id", "prize_money", "tourney_format", "match_format", "schedule_start", "schedule_end", "maplist"]


def tournament_facts(matches: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(tournament_id, at, columns) from parsed matches and tournament pages, at being (own page, time, post).

    A tournament's own page stands over what match pages call it, whichever came first.
    """
    version = lambda page, time, post: F.struct(F.lit(page).alias("page"), F.col(time).alias("time"), F.col(post).alias("post")).alias("at")
    named = matches.filter("tournament_id > 0").select("tournament_id", version(0, "played_at", "match_id"), F.nullif("tournament_name", F.lit("")).alias("name"))
    if own is None:
        return named
    return named.unionByName(own.select("tournament_id", version(1, "schedule_start", "tournament_id"), *TOURNAMENT_COLUMNS), allowMissingColumns=True)


def alias_counts(matches: DataFrame) -> DataFrame:
    side = lambda i: F.struct(F.col(f"player{i}_id").alias("player_id"), F.col(f"player{i}_name").alias("name"))
    return matches.select(F.explode(F.array(side(1), side(2))).alias("p")).groupBy("p.player_id", "p.name").agg(F.count("*").alias("cnt"))


def outcome(pages: DataFrame) -> DataFrame:
    """Pages with the status and reason that parsing gives them."""
    kind = kind_of(pages)
    good = kind.isin("match", "tournament", "vod")
    return pages.withColumn("status", F.when(good, "parsed").otherwise("skipped")).withColumn("reason", F.when(~good, kind)).drop("_kind")


def parse_summary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("status", "reason").agg(F.count("*").alias("n"))
