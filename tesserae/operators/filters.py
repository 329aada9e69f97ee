"""Row predicates as column builders; all of them reach the scan as plain filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.regex import ascii_borders, lowered, shows


def in_scope(owner: str, agent: str | None = "default", session: str | None = None) -> Column:
    """Owner and agent equal; a session only where one is asked for. agent=None: any agent."""
    if not owner.strip():
        raise ValueError("an owner is needed")
    match = F.col("owner") == owner.strip()
    if agent is not None:
        match &= F.col("agent") == (agent.strip() or "default")
    return match if session is None else match & F.col("session").eqNullSafe(F.lit(session))


def same_scope(left: str, right: str) -> Column:
    """Null-safe equality of owner, agent and session of two aliased relations."""
    return (F.col(f"{left}.owner") == F.col(f"{right}.owner")) & (F.col(f"{left}.agent") == F.col(f"{right}.agent")) & F.col(f"{left}.session").eqNullSafe(F.col(f"{right}.session"))


def contains_scope(outer: Column, inner: Column) -> Column:
    """Whether a container's session covers a row's: it has none, or the same one."""
    return outer.isNull() | (outer == inner)


def recall_allowed(share_policies: list[str] | None = None, sensitivities: list[str] | None = None) -> Column:
    """Policy filter; an absent list filters nothing. Apply it before scoring."""
    allowed = F.lit(True)
    if share_policies is not None:
        allowed &= F.col("share_policy").isin(share_policies)
    if sensitivities is not None:
        allowed &= F.col("sensitivity").isin(sensitivities)
    return allowed


def privacy_view(policy: str) -> Column:
    """Rows that a runtime policy lets out: disabled none, normal-only normal ones, allow-private also private ones; never local-only ones."""
    if policy == "disabled":
        return F.lit(False)
    seen = {"normal-only": ["normal"], "allow-private": ["normal", "private"]}[policy]
    return F.col("sensitivity").isin(seen) & (F.col("share_policy") == "allow-remote")


def _present(c: Column) -> Column:
    return F.when(c != 0, c)


def valid_at(moment: Column, start: Column, stop: Column) -> Column:
    """Half-open validity; a missing or zero bound is open."""
    start, stop = _present(start), _present(stop)
    return (start.isNull() | (start <= moment)) & (stop.isNull() | (moment < stop))


def overlaps(low: Column, high: Column, start: Column, stop: Column) -> Column:
    """Whether [start, stop) meets [low, high); a missing or zero bound is open."""
    start, stop = _present(start), _present(stop)
    return (start.isNull() | (start < high)) & (stop.isNull() | (stop > low))


def temporal_candidate(mode: str, now: int, as_of: int | None = None, window: tuple[int, int] | None = None, start: str = "valid_from", stop: str = "valid_to") -> Column:
    """Rows that a temporal plan looks at: only active and superseded ones, at the asked time."""
    known = F.col("status").isin("active", "superseded")
    if window is not None:
        return known & overlaps(F.lit(window[0]), F.lit(window[1]), F.col(start), F.col(stop))
    valid = valid_at(F.lit(now if as_of is None else as_of), F.col(start), F.col(stop))
    if mode == "current":
        return (F.col("status") == "active") & valid
    return known & valid if as_of is not None else known


def expired_status(now: Column) -> Column:
    """The status after expiry."""
    return F.when((F.col("status") == "active") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status"))


#: Wordings that try to steer a model, texts that carry secrets, and texts that are private.
INJECTION = (r"ignore\s+(?:all\s+)?(?:previous\s+)?instructions?", r"system\s*prompt", r"developer\s+message", r"忽略.{0,12}(?:规则|指令|提示词|系统)", r"(?:执行|运行).{0,12}(?:命令|脚本)")
SECRET = (r"\bsk-[a-z0-9_-]{12,}\b", r"\b(?:api[_ -]?key|password|passwd|access[_ -]?token)\b", r"密码|验证码|访问令牌|密钥")
PRIVATE = (
    r"身份证|id\s*card",
    r"家庭住址|详细地址|家庭地址|住址|address",
    r"手机号|电话号码|联系电话|phone\s*number",
    r"银行卡|银行账号|信用卡|bank\s*account|credit\s*card",
    r"生日|出生日期|病历|诊断|疾病|过敏|用药|medication|diagnosed|medical",
    r"(?:用户|我)(?:现在|目前|现)?住在",
    r"用户所在地|user\s+location|健康信息|health\s+condition",
    r"车牌|license\s*plate",
    r"妻子|丈夫|伴侣|爱人|spouse|wife|husband|partner",
    r"\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b",
    r"(?:\+?86[-\s]?)?1[3-9]\d{9}\b",
    r"\b\d{17}[\dXx]\b",
)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns, which are in lower case, is found in whatever case; a text whose lower case is longer than itself meets them as it is."""
    whole = text.rlike("(?i)" + "|".join(f"(?:{ascii_borders(p)})" for p in patterns))
    return F.when(text.contains("İ"), whole).otherwise(lowered(text, lambda low, han: shows(low, "|".join(patterns), han)))


def safe_content(text: Column) -> Column:
    """Not empty, no injection wording and no secret."""
    return F.coalesce((F.trim(text) != "") & ~_any(text, INJECTION) & ~_any(text, SECRET), F.lit(False))


def has_secret(text: Column) -> Column:
    return F.coalesce(_any(text, SECRET), F.lit(False))


def sensitivity(text: Column) -> Column:
    return F.when(_any(text, PRIVATE), "private").otherwise("normal")


def share_policy(text: Column) -> Column:
    return F.when(_any(text, PRIVATE), "local-only").otherwise("allow-remote")


#: Wordings that ask to keep an image.
IMAGE_MEMORY = r"(?:请|帮我)?(?:记住|保存|记下).{0,16}(?:图片|图像|截图|照片)|(?:图片|图像|截图|照片).{0,16}(?:记住|保存|记下)|\b(?:remember|save).{0,20}(?:image|picture|screenshot|photo)\b"


def asks_for_image_memory(text: Column) -> Column:
    return F.coalesce(_any(text, (IMAGE_MEMORY,)), F.lit(False))
