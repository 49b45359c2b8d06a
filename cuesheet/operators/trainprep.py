"""Training-data preparation over instance configs and image tables.

Pixels, models and optimisers are outside Spark's job here; these operators
produce the manifests a trainer consumes: indexes, pairings, prompts, crop
geometry, quota top-ups and shuffled batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.indexing import global_ordinal


def instance_subset(config: DataFrame, subset: Sequence[str] | None) -> DataFrame:
    """Empty/None subset keeps all instances; otherwise list membership."""
    return config if not subset else config.where(F.col("instance_name").isin(list(subset)))


def instance_paths(config: DataFrame, root: str | None) -> DataFrame:
    """Join roots to the configured folders (``root/path`` when a root is given)."""
    def j(c: str) -> Column:
        return F.col(c) if root is None else F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(root), F.col(c)))

    return config.select("instance_name", j("instance_data_root").alias("instance_path"),
                         j("class_data_root").alias("class_path"))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out_col: str = "local_idx") -> DataFrame:
    """0-based position inside each key without a per-key window: a global
    ordinal minus the key's first ordinal (one small aggregate + join)."""
    keys = list(keys)
    g = global_ordinal(df, [*keys, *order], out_col="__o")
    first = g.groupBy(*keys).agg(F.min("__o").alias("__o0"))
    return g.join(first, keys).withColumn(out_col, F.col("__o") - F.col("__o0")).drop("__o", "__o0")


def example_prompts(images: DataFrame, config: DataFrame, caption_col: str = "caption") -> DataFrame:
    """Custom caption when non-empty, else the instance prompt."""
    j = images.join(config.select(F.col("instance_name").alias("instance"), "instance_prompt"), "instance", "left")
    return j.withColumn("prompt", F.coalesce(F.nullif(F.col(caption_col), F.lit("")), F.col("instance_prompt")))


def folder_counts(config: DataFrame, instance_images: DataFrame, class_images: DataFrame) -> DataFrame:
    """Images per configured instance folder and class folder (0 when empty)."""
    ic = instance_images.groupBy("instance").agg(F.count(F.lit(1)).alias("n_instance_images"))
    cc = class_images.groupBy("instance").agg(F.count(F.lit(1)).alias("n_class_images"))
    c = config.select("instance_name", "class_data_root")
    out = c.join(ic, c["instance_name"] == ic["instance"], "left").drop("instance")
    out = out.join(cc, out["instance_name"] == cc["instance"], "left").drop("instance")
    return out.select(
        "instance_name",
        F.coalesce("n_instance_images", F.lit(0)).alias("n_instance_images"),
        F.when(F.col("class_data_root").isNull(), F.lit(None).cast("long"))
        .otherwise(F.coalesce("n_class_images", F.lit(0))).alias("n_class_images"),
    )


def class_pairing(instance_images: DataFrame, class_images: DataFrame, class_num: int | None,
                  length: str = "instance") -> DataFrame:
    """Pair examples with class images.

    ``n_class = min(count, class_num)`` per instance (no partner when 0).
    ``length="instance"``: one example per instance image ``i`` with class image
    ``i % n_class``.  ``length="max"``: ``max(n_instance, n_class)`` examples,
    example ``k`` taking instance image ``k % n_instance`` and class image
    ``k % n_class``; the larger side drives, so no per-instance explode.
    Output: instance, k, id (instance image), inst_idx, n_class, class_id.
    """
    if length not in ("instance", "max"):
        raise ValueError("length must be 'instance' or 'max'")
    inst = rank_within(instance_images.select("instance", "id"), ["instance"], ["id"], "inst_idx")
    cls = rank_within(class_images.select("instance", F.col("id").alias("class_id")), ["instance"], ["class_id"], "class_idx")
    n = cls.groupBy("instance").agg(F.count(F.lit(1)).alias("n_class"))
    if class_num is not None:
        n = n.withColumn("n_class", F.least(F.col("n_class"), F.lit(class_num)))
    cls = cls.join(n, "instance").where(F.col("class_idx") < F.col("n_class"))
    ni = inst.groupBy("instance").agg(F.count(F.lit(1)).alias("n_inst"))
    sizes = ni.join(n, "instance", "full").select(
        "instance", F.coalesce("n_inst", F.lit(0)).alias("n_inst"), F.coalesce("n_class", F.lit(0)).alias("n_class")
    )
    # instance side drives: k = inst_idx, class = k % n_class
    a = inst.join(sizes, "instance")
    if length == "max":
        a = a.where(F.col("n_inst") >= F.col("n_class"))
    a = a.withColumn("k", F.col("inst_idx")).withColumn(
        "__slot", F.when(F.col("n_class") > 0, F.pmod(F.col("inst_idx"), F.col("n_class"))))
    c = cls.select(F.col("instance").alias("c_instance"), "class_id", F.col("class_idx").alias("__slot_c"))
    out = a.join(c, (F.col("instance") == F.col("c_instance")) & (F.col("__slot") == F.col("__slot_c")), "left").select(
        "instance", "k", "id", "inst_idx", "n_class", "class_id")
    if length == "max":
        # class side drives where it is larger: k = class_idx, instance image = k % n_inst
        b = cls.select("instance", "class_id", "class_idx").join(sizes, "instance").where(
            (F.col("n_class") > F.col("n_inst")) & (F.col("n_inst") > 0))
        b = b.withColumn("k", F.col("class_idx")).withColumn("__slot", F.pmod(F.col("class_idx"), F.col("n_inst")))
        i2 = inst.select(F.col("instance").alias("i_instance"), "id", F.col("inst_idx").alias("__slot_i"))
        b = b.join(i2, (F.col("instance") == F.col("i_instance")) & (F.col("__slot") == F.col("__slot_i"))).select(
            "instance", "k", "id", F.col("__slot").alias("inst_idx"), "n_class", "class_id")
        out = out.unionByName(b)
    return out


def repeat_rows(df: DataFrame, repeats: int, rep_col: str = "rep") -> DataFrame:
    """Every row ``repeats`` times, adjacent (``rep`` = 0..repeats-1)."""
    if repeats <= 0:
        return df.where(F.lit(False)).withColumn(rep_col, F.lit(0))
    return df.withColumn(rep_col, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def global_index(images: DataFrame, repeats: int = 1) -> DataFrame:
    """Concatenate instance datasets (instance order, then image order, each image
    repeated adjacently) and number them globally; also the local index."""
    r = repeat_rows(images.select("instance", "id"), repeats)
    g = global_ordinal(r, ["instance", "id", "rep"], out_col="global_idx")
    first = g.groupBy("instance").agg(F.min("global_idx").alias("__g0"))
    return g.join(first, "instance").withColumn("local_idx", F.col("global_idx") - F.col("__g0")).drop("__g0")


def class_of(examples: DataFrame, class_images: DataFrame, class_num: int) -> DataFrame:
    """``examples`` (instance, local_idx) with the ``class_id`` at ``local_idx`` modulo the number of class images.

    The first ``class_num`` class images (instance, id) of an instance count, so
    an instance has that many rows at most in the join; null without any.
    """
    rank = F.row_number().over(Window.partitionBy("instance").orderBy("id"))
    first = class_images.select("instance", "id", rank.alias("__r")).where(F.col("__r") <= class_num)
    first = first.groupBy("instance").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    found = examples.join(first, "instance", "left")
    at = F.when(F.size("ids") > 0, F.get("ids", (F.col("local_idx") % F.size("ids")).cast("int")))
    return found.withColumn("class_id", at).drop("ids")


def validation_prompts(config: DataFrame) -> DataFrame:
    """Flatten (validation prompt, class prompt) pairs in config order, nulls dropped."""
    ex = config.select("instance_name", F.posexplode(F.array("validation_prompt", "class_prompt")).alias("j", "prompt"))
    ex = ex.where(F.col("prompt").isNotNull())
    return global_ordinal(ex, ["instance_name", "j"], out_col="pos").select("pos", "instance_name", "prompt")


def topup_rows(config: DataFrame, class_counts: DataFrame, target: int) -> DataFrame:
    """Class-image generation work: ``target - existing`` rows per class folder
    (none when already at or above target); file number = index + existing."""
    c = config.where(F.col("class_data_root").isNotNull()).select("instance_name", "class_prompt", "class_data_root")
    c = c.join(class_counts, "instance_name", "left").withColumn("existing", F.coalesce("existing", F.lit(0)))
    new = F.greatest(F.lit(target) - F.col("existing"), F.lit(0))
    c = c.withColumn("n_new", new).where(F.col("n_new") > 0)
    ex = c.select("*", F.explode(F.sequence(F.lit(0), F.col("n_new") - 1)).alias("index"))
    return ex.select("instance_name", "class_data_root", F.col("class_prompt").alias("prompt"), "index",
                     (F.col("index") + F.col("existing")).alias("file_number"))


def train_batches(examples: DataFrame, batch_size: int, seed: int, prior: bool = True) -> DataFrame:
    """Deterministic shuffle (md5 of seed and global index) then fixed-size
    batches (last partial batch kept).

    ``examples``: global_idx, prompt, class_prompt, original_size (h, w),
    crop_top_left (y, x), class_id.  A batch holds ``prompts``, and beside the
    instance images ``original_sizes`` and ``crop_top_lefts``, as arrays in the
    order of its examples.  With prior preservation the class prompts follow
    the instance prompts, and ``class_ids`` names their images; an example
    without a class image adds neither.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("global_idx").cast("string")))
    fields = ["prompt", "class_prompt", "original_size", "crop_top_left", "class_id"]
    s = global_ordinal(examples.select("global_idx", *fields).withColumn("__key", key), ["__key"], out_col="rn")
    s = s.withColumn("batch_id", F.floor(F.col("rn") / batch_size))
    agg = s.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rn", *fields))).alias("items"))
    prompts, paired = F.col("items.prompt"), F.filter("items", lambda x: x["class_id"].isNotNull())
    if prior:
        prompts = F.concat(prompts, F.transform(paired, lambda x: x["class_prompt"]))
    ids = F.transform(paired, lambda x: x["class_id"]) if prior else F.array().cast("array<long>")
    return agg.select(
        "batch_id",
        F.size("items").alias("n_examples"),
        prompts.alias("prompts"),
        F.col("items.original_size").alias("original_sizes"),
        F.col("items.crop_top_left").alias("crop_top_lefts"),
        ids.alias("class_ids"),
    )


def epoch_plan(n_batches: DataFrame, accum: int, epochs: int, max_steps: int | None, batch_size: int,
               processes: int = 1) -> DataFrame:
    """Run-size arithmetic from the batch count (one aggregate row)."""
    upd = F.ceil(F.col("n_batches") / F.lit(accum))
    steps = F.lit(max_steps) if max_steps is not None else upd * F.lit(epochs)
    return n_batches.select(
        "n_batches",
        upd.alias("updates_per_epoch"),
        steps.cast("long").alias("max_train_steps"),
        F.ceil(steps / upd).alias("num_epochs"),
        F.lit(batch_size * processes * accum).alias("total_batch_size"),
    )


def draw(seed: int, key: Column, number: int) -> Column:
    """The ``number``-th random number in [0, 1) of a row: 52 bits of a hash of (seed, key, number).

    It hangs on nothing else, so it is the same in every run, partition and retry.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(number)))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def crop_geometry(images: DataFrame, resolution: int, center_crop: bool = False, random_flip: bool = False, seed: int = 42) -> DataFrame:
    """Resize the shorter side to ``resolution`` (longer side truncated), then crop a square of it.

    ``center_crop`` takes the middle (offset rounded half to even, never
    negative); otherwise the offset is drawn evenly from all places.  With
    ``random_flip`` every second image on average is flipped.  Draws are those
    of ``draw`` by ``id``.
    """
    h, w, res = F.col("height"), F.col("width"), F.lit(resolution)
    new_w = F.when(w <= h, res).otherwise(F.floor(res * w / h)).cast("int")
    new_h = F.when(w <= h, F.floor(res * h / w)).otherwise(res).cast("int")
    d = images.select("id", h.alias("orig_h"), w.alias("orig_w"), new_h.alias("new_h"), new_w.alias("new_w"))

    def offset(side: str, number: int) -> Column:
        room = F.col(side) - res
        if center_crop:
            return F.greatest(F.lit(0), F.bround(room / 2.0).cast("int"))
        return F.floor(draw(seed, F.col("id"), number) * (room + 1)).cast("int")

    flip = draw(seed, F.col("id"), 0) < 0.5 if random_flip else F.lit(False)
    return d.select("*", offset("new_h", 1).alias("crop_y"), offset("new_w", 2).alias("crop_x"), flip.alias("flip"))


def time_ids(geometry: DataFrame, resolution: int) -> DataFrame:
    """``[h, w] + [y, x] + [res, res]`` per image."""
    return geometry.select("id", F.array("orig_h", "orig_w", "crop_y", "crop_x", F.lit(resolution), F.lit(resolution)).alias("time_ids"))


def scale_vectors(vectors: DataFrame) -> DataFrame:
    """``(x - 0.5) / 0.5`` per element."""
    return vectors.select("id", F.transform("v", lambda x: (x.cast("double") - 0.5) / 0.5).alias("scaled"))


def pad_pair(a: Column, b: Column) -> Column:
    """Pad ``a`` with zeros to the length of ``b`` (conditioning pair)."""
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.size(b) - F.size(a), F.lit(0))))


def encode_distinct(df: DataFrame, text_col: str, encoder: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Encode each distinct text once (pandas encoder over Arrow batches) and
    join the codes back."""
    distinct = df.select(text_col).distinct()

    def run(it):
        for pdf in it:
            out = encoder(pdf[text_col])
            out.insert(0, text_col, pdf[text_col].to_numpy())
            yield out

    codes = distinct.mapInPandas(run, f"{text_col} string, {schema}")
    return df.join(codes, text_col, "left")


def length_encoder(s: pd.Series) -> pd.DataFrame:
    """Toy encoder: character and whitespace-token counts."""
    return pd.DataFrame({"n_chars": s.str.len().astype("int64"), "n_words": s.str.split().str.len().astype("int64")})


def resolve_columns(dataset: DataFrame, image_column: str | None, caption_column: str | None,
                    instance_prompt: str, repeats: int = 1) -> DataFrame:
    """Pick the image column (default: first column) and the caption column
    (default: the instance prompt for every row); unknown names raise."""
    cols = dataset.columns
    img = image_column or cols[0]
    for role, name in (("image", img), ("caption", caption_column)):
        if name is not None and name not in cols:
            raise ValueError(f"no {role} column named {name!r} among {cols}")
    cap = F.col(caption_column) if caption_column else F.lit(instance_prompt)
    out = dataset.select(F.col(img).alias("image"), cap.alias("caption"))
    return repeat_rows(out, repeats) if repeats > 1 else out
