"""Queries: comment threads and web pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cvebeacon.operators.pages import BodyRule, HeadingRule, extract_articles, page_route
from cvebeacon.operators.threads import top_thread as best_thread
from cvebeacon.plans import views as V
from cvebeacon.plans.registry import query

_COMMENTS_SQL = f"""c as (select conv_id as post, {V.comment_id("turn")} as comment,
  case when turn > 2 then {V.comment_id("cast(floor((turn - 1) / 2) as bigint)")} end as parent,
  {V.COMMENT_SCORE} as score, role as author, text from conversations where turn > 0)"""


@query(
    "top_thread",
    f"""with recursive {_COMMENTS_SQL},
k as (select *, {{'unscored': score is null, 'down': -score - 1, 'comment': comment}} as step from c),
t as (select post, comment, 0 as level, [step] as path from k where parent is null
      qualify row_number() over (partition by post order by score desc nulls last, comment) = 1
  union all
  select k.post, k.comment, t.level + 1, list_append(t.path, k.step)
  from t join k on k.post = t.post and k.parent = t.comment where t.level < 2)
select t.post, t.comment, t.level, array_to_string(list_transform(t.path, lambda x: x.comment), '/') as path,
  row_number() over (partition by t.post order by t.path) as place, c.score, c.author, trim(c.text, e' \\n\\t\\r') as text
from t join c on c.post = t.post and c.comment = t.comment""",
)
def top_thread(spark, sf_dir):
    """The thread with the place of every comment in it, depth first."""
    found = best_thread(V.comments(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("post").orderBy("path")).cast("long")
    names = F.array_join(F.transform("path", lambda x: x["comment"]), "/")
    return found.withColumn("place", place).withColumn("path", names)


@query(
    "page_route",
    "select page_id, case when contains(url, 'example.com') then 'example.com' "
    "when contains(url, 'example.net') then 'example.net' end as route from pages",
)
def page_routes(spark, sf_dir):
    routes = {"example.com": HeadingRule(), "example.net": BodyRule()}
    return V.table(spark, sf_dir, "pages").select("page_id", page_route(F.col("url"), routes).alias("route"))


@query("article_extract")
def article_extract(spark, sf_dir):
    """The pages carry no publisher classes, so the rules name plain elements."""
    routes = {
        "example.com": HeadingRule("h1", None, ""),
        "example.net": BodyRule("article", None, ("p", "h1", "h2")),
        "example.org": BodyRule("article", None, ("p", "h1", "h2")),
    }
    pages = extract_articles(V.table(spark, sf_dir, "pages"), routes=routes)
    return pages.select("page_id", "url", "article_text")
