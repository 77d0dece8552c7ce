from pyspark.sql import DataFrame, SparkSession

from affinis.llm import urls
from affinis.llm.queries import query
from affinis.llm.text import read

# Host and path by plain string functions; the longest of the stated rules by a join; hosts of the method's own list where none fits.
_HOST = "case when strpos(url, '://') = 0 or url is null then '' else regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') end"
_PATH = "case when strpos(url, '://') = 0 or url is null then '' else regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') end"
_RULES = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in urls.RULES.items())
_LISTED = ", ".join(f"('{r.rstrip('/')}')" for r in urls.BLOCKED)
SQL = f"""
with parts as (
    select page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, {_PATH} as path from pages),
rules(rhost, rpath, rule, verdict) as (values {_RULES}),
listed(lhost) as (values {_LISTED}),
fitting as (
    select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
    from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
own as (
    select distinct page_id from parts join listed on (host = lhost or ends_with(host, '.' || lhost)) and starts_with(path, '/'))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case when o.page_id is not null then 'block' else 'allow' end) as verdict
from parts p left join fitting f using (page_id) left join own o using (page_id)
"""


@query("op8_url_filter", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), urls.compiled(urls.rule_table(spark)))
