"""Tables, the chunk view of a document table, and the static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages in order, with temperature and label.
STAGES = [("primary", 1, 0.1, "小学"), ("junior", 2, 0.15, "初中"), ("senior", 3, 0.2, "高中"), ("university", 4, 0.3, "大学")]

# Provider codes with their names, base URLs and models.
PROVIDERS = [
    ("deepseek", "深度求索 DeepSeek", "https://api.deepseek.com/v1", "deepseek-v4-pro deepseek-v4-flash deepseek-v3.2 deepseek-r1"),
    ("zhipu", "智谱AI GLM", "https://open.bigmodel.cn/api/paas/v4", "glm-5.2 glm-5-turbo glm-4.7-flash glm-4-flash"),
    ("qwen", "阿里通义千问", "https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen3.7-max qwen-max qwen-plus qwen-long"),
    ("moonshot", "Moonshot Kimi", "https://api.moonshot.cn/v1", "kimi-k2.6 kimi-k2.5 moonshot-v1-128k"),
    ("minimax", "MiniMax 稀宇", "https://api.minimaxi.com/v1", "MiniMax-M3 MiniMax-M2.7 MiniMax-M2.7-highspeed"),
    ("mimo", "小米 MiMo", "https://api.xiaomimimo.com/v1", "mimo-v2.5-pro mimo-v2-pro mimo-v2-flash"),
]


# Crawl presets with their stage and the words of paths that they follow.
PRESETS = [
    ("初中数学（通用）", "适合大多数数学学习网站的初中内容", "junior", "math 数学 代数 几何 函数 方程 三角形 圆 概率 统计 初中".split()),
    ("高中数学（通用）", "适合大多数数学学习网站的高中内容", "senior", "math 数学 函数 导数 圆锥曲线 数列 向量 立体几何 概率 高中 高考".split()),
    ("大学数学", "大学数学拓展内容", "university", "微积分 线性代数 概率论 数理统计 离散数学 数学分析 高等数学 微分方程".split()),
    ("小学奥数", "小学及奥数入门内容", "primary", "数学 奥数 小学 口算 应用题 几何图形 分数 小数".split()),
    ("K12 全面爬取", "自动检测学段，覆盖面最广（需要较大 maxPages）", "auto", "math 数学 代数 几何 函数 微积分 奥数 高考 中考 小学".split()),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "name string, description string, stage string, path_words array<string>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, stage_order int, temperature double, label string")


def providers(spark: SparkSession) -> DataFrame:
    """position, provider, provider_name, base_url, model_options (label, value), in the order they are offered."""
    rows = [(i, code, name, url, [(m, m) for m in models.split()]) for i, (code, name, url, models) in enumerate(PROVIDERS)]
    return spark.createDataFrame(rows, "position long, provider string, provider_name string, base_url string, model_options array<struct<label:string,value:string>>")


def files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files of a folder, not of its sub-folders, by path: path, name, size, modified.

    Only metadata columns are read, so contents never leave the disk.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    named = listed.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return named.where(F.endswith(F.lower("name"), F.lit(suffix))).orderBy("path")


def safe_upload_name(name):
    """A file name with the characters that file systems refuse replaced."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks of a knowledge base.

    Grades, weights and offsets are derived from the id; offsets have plateaus, as chunk
    offsets do.
    """
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("source_file"),
        F.col("text").alias("content"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'junior' WHEN 2 THEN 'senior' ELSE 'university' END").alias("grade"),
        F.substring(F.split("text", "\n").getItem(0), 1, 49).alias("chapter_title"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 0.0D WHEN 1 THEN 0.85D WHEN 2 THEN 0.7D ELSE 1.0D END").alias("weight"),
        F.expr("CAST(doc_id div 2 * 500 AS INT)").alias("start_char"),
    )
