from pyspark.sql import functions as F

EVENT = (
    "id string, match_id int, index_num int, minute int, second int, timestamp string, possession int, team string, player string, type string, "
    "play_pattern string, location_x double, location_y double, pass_end_location_x double, pass_end_location_y double, pass_length double, "
    "pass_outcome string, pass_recipient string, carry_end_location_x double, carry_end_location_y double, shot_statsbomb_xg double, "
    "shot_outcome string, shot_type string, shot_key_pass_id string, counterpress boolean, duel_outcome string, position string, period int, "
    "substitution_replacement_name string, bad_behaviour_card string, foul_committed_card string")
FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def events(spark, rows):
    """Events from short dicts; what is not named is NULL or a plain default."""
    out = []
    for i, r in enumerate(rows):
        base = {"id": f"e{i}", "match_id": 1, "index_num": i + 1, "minute": i, "second": 0, "possession": 1, "team": "A", "player": "p",
                "type": "Pass", "play_pattern": "Regular Play", "period": 1, "location_x": 50.0, "location_y": 40.0}
        base.update(r)
        out.append(tuple(base.get(f) for f in FIELDS))
    return spark.createDataFrame(out, EVENT)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def long_range(spark, n):
    return spark.range(n).withColumn("v", (F.col("id") * 7919 % 101).cast("double"))
