"""JSON embedded in captured pages and API bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import regexes as R
from ..functions.urls import resolve_url

CAMPAIGN_SCHEMA = (
    "array<struct<Campaign:struct<id:string,title:string,hcolor:string,UUID:string,featured:boolean,"
    "earns:string,time_required:string,modified:string,tasks_completed:string,avaliable_positions:string>,"
    "TargetWorker:struct<name:string,id:string>,Cstatus:struct<color:string,id:string>>>"
)


def job_list_records(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                     detail_path: str = "JobDetails/") -> DataFrame:
    """Task list page with ``var records = [...];`` -> one row per campaign
    (A5/N1), with the detail page URL resolved against the list page."""
    arr = F.from_json(F.regexp_extract(html_col, R.RECORDS_JS, 1), CAMPAIGN_SCHEMA)
    rows = pages.select(url_col, F.inline_outer(arr)).where(F.col("Campaign").isNotNull())
    c = F.col("Campaign")
    return rows.select(
        c["id"].alias("id"), c["title"].alias("name"), c["UUID"].alias("uuid"),
        c["featured"].alias("featured"), c["earns"].cast("double").alias("payment"),
        c["time_required"].cast("bigint").alias("duration"),
        F.to_timestamp(c["modified"], "yyyy-MM-dd HH:mm:ss").alias("modified"),
        c["tasks_completed"].cast("bigint").alias("work_done"),
        c["avaliable_positions"].cast("bigint").alias("work_total"),
        F.col("TargetWorker.name").alias("target_workers"),
        resolve_url(F.col(url_col), F.concat(F.lit(detail_path), c["UUID"])).alias("job_url"))


LOOKUP_SCHEMA = (
    "resultCount int, results array<struct<trackId:bigint,trackName:string,kind:string,"
    "description:string,artworkUrl60:string,trackViewUrl:string,bundleId:string,artistId:bigint,"
    "sellerName:string,releaseDate:string,price:double,genres:array<string>,primaryGenreName:string,"
    "userRatingCountForCurrentVersion:bigint,trackContentRating:string,"
    "averageUserRatingForCurrentVersion:double,languageCodesISO2A:array<string>,"
    "currentVersionReleaseDate:string,wrapperType:string,version:string,currency:string,"
    "releaseNotes:string,averageUserRating:double,userRatingCount:bigint,minimumOsVersion:string,"
    "isVppDeviceBasedLicensingEnabled:boolean>>"
)


def platform_flags(kind: Column) -> list[Column]:
    """iphone, ipad, osx flags of an app kind (C11); a missing kind is a phone app."""
    mac = kind == C.MAC_KIND
    return [F.when(mac, 0).otherwise(1).alias("iphone"), F.when(mac, 0).otherwise(1).alias("ipad"),
            F.when(mac, 1).otherwise(0).alias("osx")]


def counter(value: Column) -> Column:
    """A counter that the result may lack (C10): 0 when missing."""
    return F.coalesce(value, F.lit(0))


def referrer_label(referrer: Column) -> Column:
    """Label of an app (C12): a seed has no referrer and is a paid app."""
    return F.when(referrer.isNull(), F.lit(C.LABEL_PAID)).otherwise(F.lit(C.LABEL_UNKNOWN))


def app_lookup_rows(bodies: DataFrame, body_col: str = "body", keep=("referrer", "crawl_ts")) -> DataFrame:
    """App lookup JSON -> App rows (A6/N11/C10/C11): ``results[0]``, dropped
    when empty; counters missing from the result default to 0 (release notes
    to '0'); platform flags from the kind; developer id from artistId."""
    keep = [k for k in keep if k in bodies.columns]
    r = bodies.select(*keep, F.get(F.from_json(body_col, LOOKUP_SCHEMA)["results"], 0).alias("r"))
    r = r.where(F.col("r").isNotNull())
    return r.select(
        F.col("r.trackId").cast("string").alias("id"),
        F.col("r.trackName").alias("app_name"),
        F.coalesce(F.col("r.isVppDeviceBasedLicensingEnabled").cast("int"), F.lit(0)).alias("enabled"),
        *platform_flags(F.col("r.kind")),
        F.array(F.col("r.description")).alias("description"),
        F.col("r.artworkUrl60").alias("image_url"), F.col("r.trackViewUrl").alias("app_store_url"),
        F.col("r.bundleId").alias("bundleId"),
        F.col("r.artistId").cast("string").alias("developer_id"),
        F.col("r.sellerName").alias("developer_name"),
        F.col("r.releaseDate").alias("release_date"), F.col("r.price").alias("price"),
        F.col("r.genres").alias("genres"), F.col("r.primaryGenreName").alias("main_cat"),
        counter(F.col("r.userRatingCountForCurrentVersion")).alias("rating_count_for_cur_version"),
        F.col("r.trackContentRating").alias("content_rating_age_group"),
        F.coalesce("r.averageUserRatingForCurrentVersion", F.lit(0.0)).alias("avg_rating_for_cur_version"),
        F.col("r.languageCodesISO2A").alias("languages"),
        F.col("r.currentVersionReleaseDate").alias("cur_ver_release_date"),
        F.col("r.wrapperType").alias("app_type"), F.col("r.version").alias("version"),
        F.col("r.currency").alias("currency"),
        F.coalesce("r.releaseNotes", F.lit("0")).alias("release_notes"),
        F.coalesce("r.averageUserRating", F.lit(0.0)).alias("avg_rating"),
        counter(F.col("r.userRatingCount")).alias("rating_count"),
        F.col("r.minimumOsVersion").alias("min_os_version"),
        *[F.col(k) for k in keep],
        referrer_label(F.col("referrer") if "referrer" in keep else F.lit(None)).alias("label"))
