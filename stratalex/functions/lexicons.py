"""The word lists that stage, type and topic detection look for."""

# Chunk lexicons by stage.
CHUNK_PRIMARY = "口算 四则运算 乘法口诀 分数 小数 面积 体积 应用题 图形 年月日 克与千克 米与厘米 人民币 钟表 线段".split()
CHUNK_JUNIOR = "一次函数 二次函数 三角形 全等 勾股定理 圆 方程 不等式 概率 统计 有理数 实数 平面直角坐标系 平行四边形 投影".split()
CHUNK_SENIOR = "导数 微分 积分 圆锥曲线 数列 向量 复数 立体几何 排列组合 二项式定理 三角函数 参数方程 极坐标 空间向量 双曲线".split()
CHUNK_UNIVERSITY = "微积分基本定理 线性代数 矩阵 特征值 离散数学 数理统计 正态分布 极限 ε-δ 级数 多元函数 偏导数 重积分 微分方程 群论".split()

# Page lexicons by stage.
PAGE_PRIMARY = (
    "口算 四则运算 乘法口诀 分数 小数 百分数 面积 体积 周长 应用题 图形 年月日 克与千克 米与厘米 人民币 钟表 线段 角 "
    "长方形 正方形 三角形面积 梯形面积 因数倍数 质数合数 最大公约数 最小公倍数 小学数学"
).split()
PAGE_JUNIOR = (
    "一次函数 二次函数 三角形 全等 勾股定理 圆 方程 不等式 概率 统计 有理数 实数 无理数 平面直角坐标系 平行四边形 矩形 菱形 正方形 "
    "梯形 一元一次方程 二元一次方程组 一元二次方程 分式方程 因式分解 整式 幂的运算 相似三角形 锐角三角函数 投影与视图 中考 初中数学"
).split()
PAGE_SENIOR = (
    "导数 微分 积分 圆锥曲线 数列 向量 复数 立体几何 排列组合 二项式定理 三角函数 参数方程 极坐标 空间向量 双曲线 抛物线 椭圆 对数 "
    "指数函数 幂函数 等差数列 等比数列 正弦定理 余弦定理 基本不等式 柯西不等式 二次函数 绝对值不等式 线性规划 三视图 二面角 异面直线 线面角 "
    "高考 高中数学 必修 选择性必修 选修"
).split()
PAGE_UNIVERSITY = (
    "微积分 线性代数 矩阵 特征值 离散数学 数理统计 正态分布 ε-δ 级数 多元函数 偏导数 重积分 微分方程 群论 概率论 数学分析 高等数学 泛函分析 "
    "抽象代数 数值分析 复变函数 常微分方程 随机过程 多元统计 实变函数 拓扑学 图论 组合数学"
).split()

# What file names and paths say about the stage.
NAME_UNIVERSITY = "university 大学 高等 微积分 线性代数 离散数学 概率论 数理统计 数学建模 数学竞赛 数学分析 考研 组合数学 图论 数值分析 应用数学 复变函数 常微分 抽象代数 泛函分析 吉米多维奇".split()
PATH_UNIVERSITY = "university 大学 高等 微积分 线性代数 离散数学 概率论 数理统计 数学建模 数学竞赛 数学分析 考研数学 组合数学 图论 数值分析 应用数学 复变函数 常微分 抽象代数 泛函分析".split()
NAME_SENIOR, NAME_PRIMARY, NAME_JUNIOR = "senior 高中 高考".split(), "primary 小学".split(), "junior 初中 中考".split()

# Markers of question and source types.
PROOF, GEOMETRY, FUNCTION, CALCULATION = "证明 求证".split(), "如图 △ ∠ 几何 图形".split(), "f( 函数 定义域 值域".split(), "计算 解 求值 =".split()
TEXTBOOK, EXAM, LECTURE = "教材 课本 textbook".split(), "试卷 真题 考试 期中 期末 高考 中考 exam".split(), "讲义 课件 lecture 竞赛 奥数 联赛".split()

# LaTeX commands that are recognised outside of dollar signs.
LATEX = (
    "frac|sqrt|sum|int|lim|infty|pm|mp|times|div|cdot|leq|geq|neq|approx|equiv|sim|partial|nabla|forall|exists|in|notin|subset|subseteq|cup|cap|angle|triangle|"
    "alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|mathbf|mathbb|mathcal|bar|hat|vec|dot|widetilde|widehat|overline|underline|operatorname|"
    "text|begin|end|left|right|sin|cos|tan|cot|sec|csc|arcsin|arccos|arctan|log|ln|lg|exp|det|dim|hom|ker|max|min|sup|inf|limsup|liminf|Pr|E|Var|Cov|Corr"
)
