"""Entities kept both ways round (movies with their casts, actors with their roles) and the prefix index of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Index entries that a prefix search uses.
SEARCH_ENTRIES = 9


def casts(roles: DataFrame) -> DataFrame:
    """(movie_id, members): roles (movie_id, actor_id, role, position) gathered by movie, in order."""
    return roles.groupBy("movie_id").agg(F.array_sort(F.collect_list(F.struct("position", "actor_id", "role"))).alias("m")).select("movie_id", F.transform("m", lambda x: F.struct(x["actor_id"], x["role"])).alias("members"))


def roles_of(roles: DataFrame) -> DataFrame:
    """(actor_id, roles): the inverse."""
    return roles.groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("position", "movie_id", "role"))).alias("m")).select("actor_id", F.transform("m", lambda x: F.struct(x["movie_id"], x["role"])).alias("roles"))


def list_roles(casts_: DataFrame) -> DataFrame:
    """(movie_id, actor_id, role): casts unnested, by name of column."""
    return casts_.select("movie_id", F.explode("members").alias("m")).select("movie_id", "m.actor_id", "m.role")


def movie_display(movies: DataFrame, roles: DataFrame, actors: DataFrame) -> DataFrame:
    """(movie_id, title, released, cast): each movie with its cast's names, in order; movies without a cast have an empty one."""
    named = roles.join(actors.select("actor_id", "name"), "actor_id")
    members = named.groupBy("movie_id").agg(F.array_sort(F.collect_list(F.struct("position", "actor_id", "name", "role"))).alias("m"))
    cast = F.coalesce(F.transform("m", lambda x: F.struct(x["actor_id"].alias("actor_id"), x["name"].alias("actor"), x["role"].alias("role"))), F.array().cast("array<struct<actor_id:bigint,actor:string,role:string>>"))
    return movies.join(members, "movie_id", "left").select("movie_id", "title", "released", cast.alias("cast"))


def actor_display(actors: DataFrame, roles: DataFrame, movies: DataFrame) -> DataFrame:
    """(actor_id, name, born, roles): each actor with the titles of the roles, in order."""
    titled = roles.join(movies.select("movie_id", "title"), "movie_id")
    played = titled.groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("position", "movie_id", "title", "role"))).alias("m"))
    out = F.coalesce(F.transform("m", lambda x: F.struct(x["movie_id"].alias("movie_id"), x["title"].alias("title"), x["role"].alias("role"))), F.array().cast("array<struct<movie_id:bigint,title:string,role:string>>"))
    return actors.join(played, "actor_id", "left").select("actor_id", "name", "born", out.alias("roles"))


def name_index(movies: DataFrame, actors: DataFrame) -> DataFrame:
    """(text, movies, actors): lower-case title or name -> sets of ids."""
    both = movies.select(F.lower("title").alias("text"), F.col("movie_id").alias("m"), F.lit(None).cast("long").alias("a")).unionByName(
        actors.select(F.lower("name").alias("text"), F.lit(None).cast("long").alias("m"), F.col("actor_id").alias("a"))
    )
    return both.groupBy("text").agg(F.array_sort(F.collect_set("m")).alias("movies"), F.array_sort(F.collect_set("a")).alias("actors"))


def prefix(index: DataFrame, query: str, most: int = SEARCH_ENTRIES) -> DataFrame:
    """The first ``most`` entries, in order, that begin with the query, whatever its case."""
    return index.where(F.col("text").startswith(query.lower())).orderBy("text").limit(most)


def search(index: DataFrame, query: str, movies: DataFrame, actors: DataFrame, most: int = SEARCH_ENTRIES) -> DataFrame:
    """(kind, id, text) of the entities that a prefix search finds; ids without a row are left out."""
    # At most ``most`` names, but of ids that bear a name there is no bound: how they are joined is left to their size.
    hits = prefix(index, query, most)
    m = hits.select(F.explode("movies").alias("movie_id")).distinct()
    a = hits.select(F.explode("actors").alias("actor_id")).distinct()
    return (
        movies.join(m, "movie_id").select(F.lit("movie").alias("kind"), F.col("movie_id").alias("id"), F.col("title").alias("text"))
        .unionByName(actors.join(a, "actor_id").select(F.lit("actor").alias("kind"), F.col("actor_id").alias("id"), F.col("name").alias("text")))
    )


def violations(movies: DataFrame, actors: DataFrame, roles: DataFrame) -> DataFrame:
    """(error, n): untitled movies, nameless actors, roles without an id, two roles of an actor in a movie, and ids that lead nowhere."""

    def counted(error: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(error).alias("error"), "n")

    def unknown(error: str, key: str, known: DataFrame) -> DataFrame:
        ids = roles.groupBy(key).agg(F.count("*").alias("roles"))
        return ids.join(known, key, "left_anti").agg(F.coalesce(F.sum("roles"), F.lit(0)).alias("n")).select(F.lit(error).alias("error"), "n")

    parts = [
        counted("no title", movies.where("title IS NULL OR title = ''")), counted("no name", actors.where("name IS NULL OR name = ''")),
        counted("no id", roles.where("movie_id IS NULL OR actor_id IS NULL")), counted("two roles", roles.groupBy("movie_id", "actor_id").count().where("count > 1")),
        # Roles are counted by id before they meet the table, so that a join has a row for each id, not for each role.
        unknown("no such movie", "movie_id", movies), unknown("no such actor", "actor_id", actors),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def role_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(movie_id, actor_id, change): what saving a movie's or an actor's roles adds, removes or alters on the other side."""
    o, n = old.select("movie_id", "actor_id", F.col("role").alias("old_role")), new.select("movie_id", "actor_id", F.col("role").alias("new_role"))
    change = F.when(F.col("old_role").isNull(), "added").when(F.col("new_role").isNull(), "removed").when(F.col("old_role") != F.col("new_role"), "changed")
    return o.join(n, ["movie_id", "actor_id"], "full_outer").select("movie_id", "actor_id", change.alias("change")).where("change IS NOT NULL")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(text, id, change) of index entries when titles change; a change of case alone is none."""
    o = old.select(F.lower("title").alias("text"), F.col("movie_id").alias("id"), F.lit(1).alias("o"))
    n = new.select(F.lower("title").alias("text"), F.col("movie_id").alias("id"), F.lit(1).alias("n"))
    both = o.join(n, ["text", "id"], "full_outer")
    return both.where("o IS NULL OR n IS NULL").select("text", "id", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))
