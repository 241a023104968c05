"""Fixed values of the annotation layers."""

STRUCTS = ["短句", "句从"]
SHOT_TYPES = ["信息", "对话", "心理", "动作", "事件", "环境"]
SHOT_FUNCS = ["塑造人物", "引入世界观", "设置动机", "推进", "铺垫", "反转", "爆发", "转场", "收束分镜", "悬念"]
CHAPTER_FUNCS = ["开端", "推进", "铺垫", "爆发", "转折", "收束章节", "过渡"]
MAINLINE_STATES = ["主线启动", "推进", "受阻", "达成", "更换"]
LIFECYCLE_STATES = ["悬置", "已回收"]
TARGET_STATES = ["确立", "推进", "达成", "搁置", "失败"]
SCHEMAS = {"chapter_table": "dsh/chapter-table/v1", "event": "dsh/event-card/v1", "volume": "dsh/volume-card/v1"}

#: Function words that are no entities.
LEXICON_STOP_WORDS = (
    "自己 什么 一个 没有 现在 这个 那个 时候 就是 不是 知道 已经 有点 有人 还是 真的 不会 不能 可以 可能 但是 因为 所以 如果 虽然 然后 可是 只是 觉得 "
    "说道 说着 起来 出来 过来 进去 回来 上去 下去 上来 一下 一点 一起 一边 一直 一定 一样 一时 一天 一次 两人 三人 众人 大家 他们 我们 你们 她们 咱们 "
    "那些 这时 那时 此时 此刻 眼前 面前 身边 身后 心里 第一 一番 一事 一物 一切 何事 如何 何为 今日 明日 当时 当下 原来 本来 方才 此后 后来 其中 其间 "
    "恐怕 只怕 想必 不知 不曾 未曾 只得 只好 但凡"
).split()
#: Characters at which a statistical word always ends.
CUT_CHARS = "的了在是我你他她它们这那就也都说道看想着过什么怎自己有没不要会能到去来和与及把被然后因为所以如果虽时候现已经借请得之其乃遂且便亦故方将令闻见言问笑回叫让往于於者乎焉哉矣耳曰云谓"
