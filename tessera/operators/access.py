"""Table functions over shared workspaces: what a user may see, as DataFrames with the caller's parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(emails: Column, email: str | None) -> Column:
    """Whether an address is in a list of addresses. Case counts here, unlike in `visible_workflows`."""
    return F.lit(False) if email is None else F.coalesce(F.array_contains(emails, email), F.lit(False))


def visible_reviews(reviews: DataFrame, projects: DataFrame, user: str, email: str | None = None, project=None) -> DataFrame:
    """Reviews (id, project_id, user_id, document_ids, shared_with, updated_at) that the user owns, that are shared with the
    address, or whose project is the user's or shared with the address; the last updated first.

    Adds is_owner and document_count; null lists count as empty ones. The projects that are open to the caller are found once and
    semi-joined, so a review comes out once however it is visible."""
    some = reviews if project is None else reviews.filter(F.col("project_id") == F.lit(project))
    open_to = projects.filter((F.col("user_id") == user) | listed(F.col("shared_with"), email)).select(F.col("id").alias("project_id")).distinct()
    joined = some.join(open_to.withColumn("through_project", F.lit(True)), "project_id", "left")
    mine = F.coalesce(F.col("user_id") == user, F.lit(False))
    seen = joined.filter(mine | listed(F.col("shared_with"), email) | F.col("through_project").isNotNull())
    documents = F.coalesce("document_ids", F.array().cast(reviews.schema["document_ids"].dataType))
    out = seen.select(*(F.col(c) for c in reviews.columns if c != "document_ids"), documents.alias("document_ids"), mine.alias("is_owner"))
    return out.withColumn("document_count", F.size("document_ids").cast("long")).orderBy(F.desc("updated_at"), "id")


def own_chats(chats: DataFrame, profiles: DataFrame, user: str, limit: int | None = None) -> DataFrame:
    """The user's chats (id, user_id, title, created_at), the newest first, with the creator's display name where there is a
    profile; 1,000 at most unless `limit` says otherwise."""
    names = profiles.select(F.col("user_id").cast("string").alias("user_id"), F.col("display_name").alias("creator_display_name"))
    return chats.filter(F.col("user_id") == user).join(names, "user_id", "left").orderBy(F.desc("created_at"), "id").limit(1000 if limit is None else limit)


def visible_workflows(workflows: DataFrame, shares: DataFrame, profiles: DataFrame, user: str, email: str | None = None, kind: str | None = None) -> DataFrame:
    """Workflows (id, user_id, type, is_system, created_at) that are the user's, the system's, or shared with the address, the
    newest first; adds is_owner, allow_edit and shared_by_name.

    Addresses are compared without case, and each share that fits gives a row: a workflow that is shared with two spellings of an
    address comes out twice."""
    fits = shares.filter(F.lower("shared_with_email") == (email or "").lower())
    fits = fits.select(F.col("workflow_id").alias("id"), F.lit(True).alias("shared"), F.col("allow_edit").alias("may_edit"), "shared_by_user_id")
    names = profiles.select(F.col("user_id").cast("string").alias("shared_by_user_id"), "display_name")
    some = workflows if kind is None else workflows.filter(F.col("type") == kind)
    joined = some.join(fits, "id", "left").join(names, "shared_by_user_id", "left")
    mine, system = F.coalesce(F.col("user_id") == user, F.lit(False)), F.coalesce("is_system", F.lit(False))
    seen = joined.filter(mine | system | (F.lit(email is not None) & F.col("shared").isNotNull()))
    may_edit = F.when(mine, True).when(system, False).otherwise(F.coalesce("may_edit", F.lit(False)))
    name = F.when(~mine & ~system, F.col("display_name"))
    return seen.select(*workflows.columns, mine.alias("is_owner"), may_edit.alias("allow_edit"), name.alias("shared_by_name")).orderBy(F.desc("created_at"), "id")
