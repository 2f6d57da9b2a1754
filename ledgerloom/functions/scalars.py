"""Scalar rules of the ledger, as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of actions and of currencies.
ACTION_ALIASES = {
    "B": "BUY", "PURCHASE": "BUY", "BOUGHT": "BUY", "S": "SELL", "SOLD": "SELL", "SALE": "SELL", "DIV": "DIVIDEND", "DIVIDENDS": "DIVIDEND",
    "TRANSFER_IN": "TFR_IN", "TRANSFER IN": "TFR_IN", "TFRIN": "TFR_IN", "TRANSFER_OUT": "TFR_OUT", "TRANSFER OUT": "TFR_OUT", "TFROUT": "TFR_OUT",
    "CONTRIB": "CONTRIBUTION", "DEPOSIT": "CONTRIBUTION", "FEE": "FCH", "FEES": "FCH", "INTEREST": "FCH", "FOREX": "FXT", "FX": "FXT", "CURRENCY": "FXT",
    "RETURN_OF_CAPITAL": "ROC", "STOCK_SPLIT": "SPLIT", "WITHDRAW": "WITHDRAWAL", "CASH_OUT": "WITHDRAWAL",
}
ACTIONS = ["BUY", "SELL", "DIVIDEND", "CONTRIBUTION", "FCH", "FXT", "ROC", "SPLIT", "TFR_IN", "TFR_OUT", "WITHDRAWAL"]
CURRENCY_ALIASES = {"US$": "USD", "C$": "CAD", "CAD$": "CAD", "CANADIAN": "CAD"}
CURRENCIES = ["USD", "CAD", "EUR"]
#: Exchange suffixes that a quote symbol keeps.
EXCHANGES = ["TO", "V", "NE", "CN", "AQ", "L", "AX", "HK"]
#: Account types and other words for them.
ACCOUNT_WORDS = {
    "NON_REGISTERED": "NON_REGISTERED", "NONREG": "NON_REGISTERED", "NREG": "NON_REGISTERED", "PERSONAL": "NON_REGISTERED", "CASH": "NON_REGISTERED", "TAXABLE": "NON_REGISTERED",
    "NONREGISTERED": "NON_REGISTERED", "NON-REGISTERED": "NON_REGISTERED", "NON-REG": "NON_REGISTERED", "MARGIN": "MARGIN", "CORPORATE": "CORPORATE", "TFSA": "TFSA", "RRSP": "RRSP", "RRIF": "RRIF", "RESP": "RESP", "FHSA": "FHSA", "LIRA": "LIRA",
}
TAXABLE = ["NON_REGISTERED", "MARGIN", "CORPORATE"]
#: The signs that amount, units and price of an action must have; 0 leaves them.
SIGNS = {"BUY": (-1, 1, 0), "SELL": (1, -1, 0), "WITHDRAWAL": (-1, 0, 0), "CONTRIBUTION": (1, 0, 0), "ROC": (1, 0, 0), "SPLIT": (0, 1, 1), "TFR_IN": (1, 1, 0), "TFR_OUT": (-1, -1, 0)}
#: Actions that settle on their own day, and those that settle after business days; first days of the one-day lag by currency.
SAME_DAY = ["DIVIDEND", "CONTRIBUTION", "FCH", "ROC", "TFR_IN", "TFR_OUT", "WITHDRAWAL"]
AFTER_DAYS = ["BUY", "SELL", "FXT", "SPLIT"]
NEXT_DAY_FROM = {"USD": "2024-05-28", "CAD": "2024-05-27"}
#: Date formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "M.d.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def settle_date(day: Column, lag: int) -> Column:
    """The weekday `lag` weekdays after a day, in closed form; a weekend counts as its Friday."""
    of_week = F.least(F.weekday(day), F.lit(4))
    back = F.weekday(day) - of_week
    total = of_week + lag
    return F.date_add(day, (F.floor(total / 5) * 7 + total % 5 - of_week - back).cast("int"))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]."""
    until = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.weekday(d), F.lit(4)) + 1
    return (until(end) - until(start)).cast("int")


def settle_lag(action: Column, currency: Column, day: Column) -> Column:
    """Business days until settlement: none, one since the day on which a currency's markets changed, else two."""
    since = F.lit(None).cast("date")
    for name, first in NEXT_DAY_FROM.items():
        since = F.when(currency == name, F.lit(first).cast("date")).otherwise(since)
    return F.when(action.isin(AFTER_DAYS), F.when(day >= since, 1).otherwise(2)).when(action.isin(SAME_DAY), 0)


def settled(action: Column, currency: Column, day: Column, given: Column | None = None) -> Column:
    """struct of date and calculated (0 or 1): a given date stays, others follow from the action; without a trade day null and 0."""
    lag = settle_lag(action, currency, day)
    found = F.when(lag == 0, day).otherwise(F.when(lag == 1, settle_date(day, 1)).otherwise(settle_date(day, 2)))
    flag = F.when(day.isNotNull() & (lag > 0), 1).otherwise(0)
    kept = given if given is not None else F.lit(None).cast("date")
    return F.struct(F.coalesce(kept, found).alias("date"), F.when(kept.isNotNull(), 0).otherwise(flag).alias("calculated"))


def previous_weekday(day: Column) -> Column:
    """The last Monday to Friday before a day."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def date_parse(text: Column) -> Column:
    """yyyy-mm-dd of a date in one of many forms, else null; what looks like one already stays as it is."""
    clean = F.trim(text.cast("string"))
    day = r"^(\d{4}-\d{2}-\d{2})"
    stamp = day + r"(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?|\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)$"
    tried = [F.date_format(F.try_to_date(clean, f), "yyyy-MM-dd") for f in DATE_FORMATS]
    return F.when(clean.rlike(day + "$"), clean).when(clean.rlike(stamp), F.regexp_extract(clean, stamp, 1)).otherwise(F.coalesce(*tried))


def convertible(currency: Column) -> Column:
    """The currency, or an error for one that has no rates."""
    return F.when(currency.isin("CAD", "USD"), currency).otherwise(F.raise_error(F.concat(F.lit("no exchange rate for "), currency)).cast("string"))


def to_cad(amount: Column, currency: Column, rate: Column) -> Column:
    return F.when(convertible(currency) == "CAD", amount).otherwise(amount * rate)


def from_cad(amount: Column, currency: Column, rate: Column) -> Column:
    return F.when(convertible(currency) == "CAD", amount).otherwise(amount / rate)


def statement_parts(description: Column) -> Column:
    """struct of ticker, units and txn_date (text) found in a statement's description."""
    up = F.upper(description)
    found = lambda pattern: F.nullif(F.regexp_extract(up, pattern, 1), F.lit(""))
    dates = [found(p) for p in (r"(\d{4}-\d{2}-\d{2})", r"(\d{2}/\d{2}/\d{4})", r"(\d{2}-\d{2}-\d{4})")]
    ticker = found(r"^([A-Z]{1,5}(?:[.-][A-Z]{1,5})?)\s+-")
    return F.struct(ticker.alias("ticker"), found(r"(\d+(?:\.\d+)?)\s*(?:SHARES?|UNITS?)").cast("double").alias("units"), date_parse(F.coalesce(*dates)).alias("txn_date"))


def transfer_code(code: Column) -> Column:
    """TFR_OUT or TFR_IN of a statement's code, else null."""
    up = F.upper(F.trim(code))
    return F.when(up.startswith("TRFOUT"), "TFR_OUT").when(up.startswith("TRFIN"), "TFR_IN")


def statement_account(path: Column) -> Column:
    """The account that a statement's file name holds."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)ws_statement_([^/]+)_\d{6}(?:\.[^./]*)?$", 1), F.lit(""))


def txn_summary(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in columns])


def dec(cell: Column) -> Column:
    """Any cell as a decimal; what is no finite number is zero."""
    return F.coalesce(F.trim(cell.cast("string")).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def norm_header(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9$]", "")


def norm_ticker(ticker: Column) -> Column:
    """Upper-cased and trimmed; null unless it has letters, digits, dots and hyphens only."""
    clean = F.upper(F.trim(ticker))
    return F.when(clean.rlike("^[A-Z0-9.-]+$"), clean)


def norm_numeric(text: Column) -> Column:
    """A decimal from text with dollar signs and commas, null where it is none."""
    return F.regexp_replace(F.trim(text), "[$,]", "").try_cast("decimal(20,10)")


def action_alias(text: Column) -> Column:
    clean = F.upper(F.trim(text))
    return F.coalesce(_mapped(clean, ACTION_ALIASES), F.when(clean.isin(ACTIONS), clean))


def currency_alias(text: Column) -> Column:
    clean = F.upper(F.trim(text))
    return F.coalesce(_mapped(clean, CURRENCY_ALIASES), F.when(clean.isin(CURRENCIES), clean))


def cad_suffix(ticker: Column, currency: Column) -> Column:
    """CAD tickers end in .TO."""
    return F.when((currency != "CAD") | ticker.endswith(".TO"), ticker).otherwise(F.concat(ticker, F.lit(".TO")))


def quote_symbol(ticker: Column) -> Column:
    """Exchange suffixes stay; other dots become hyphens."""
    suffix = F.regexp_extract(ticker, r"\.([^.]*)$", 1)
    keeps = suffix.isin(EXCHANGES)
    head = F.regexp_replace(ticker, r"\.[^.]*$", "")
    return F.when(keeps, F.concat(F.translate(head, ".", "-"), F.lit("."), suffix)).otherwise(F.translate(ticker, ".", "-"))


def account_type(account: Column, overrides: dict[str, str] | None = None, naming: bool = True) -> Column:
    """The type given for the account, as it is written or in upper case; else the rightmost word that names a type, else the longest type that the name holds, else UNKNOWN. Without `naming`, names tell nothing."""
    given = [F.when((account == name) | (F.upper(account) == name), kind) for name, kind in (overrides or {}).items()]
    if not naming:
        return F.coalesce(*given, F.lit("UNKNOWN"))
    name = F.upper(F.trim(account))
    known = F.create_map(*[F.lit(x) for pair in ACCOUNT_WORDS.items() for x in pair])
    named = F.filter(F.transform(F.reverse(F.split(name, r"[-_\s]+")), lambda w: known[w]), lambda t: t.isNotNull())
    held = [F.when(name.contains(word), ACCOUNT_WORDS[word]) for word in sorted(ACCOUNT_WORDS, key=lambda w: (-len(w), w))]
    return F.coalesce(*given, F.get(named, F.lit(0)), *held, F.lit("UNKNOWN"))


def q2(x: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(x, 2)


def q4(x: Column) -> Column:
    return F.bround(x, 4)


def q6(x: Column) -> Column:
    return F.bround(x, 6)


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / F.nullif(d, F.lit(0.0)))


def signed(action: Column, value: Column, which: int) -> Column:
    """value with the sign that its action requires; which: 0 an amount, 1 units, 2 a price."""
    want = F.coalesce(F.create_map(*[F.lit(x) for a, s in SIGNS.items() for x in (a, s[which])])[action], F.lit(0))
    return F.when((want != 0) & (F.signum(value) == -want), -value).otherwise(value)


def fee_fits(action: Column, amount: Column, price: Column, units: Column, fee: Column) -> tuple[Column, Column]:
    """Whether a trade's amount fits without and with the fee inside; `fee` is positive where it was charged."""
    gross, tolerance = F.abs(price * units).cast("double"), 0.01 + 0.005 * F.abs(units).cast("double")
    paid, charged = F.abs(amount).cast("double"), fee.cast("double")
    return F.abs(paid - gross) <= tolerance, F.abs(paid - F.when(action == "BUY", gross + charged).otherwise(gross - charged)) <= tolerance


def fee_vote(action: Column, amount: Column, price: Column, units: Column, fee: Column) -> Column:
    """EXCLUDED or INCLUDED if the amount fits one convention alone, else null."""
    excluded, included = fee_fits(action, amount, price, units, fee)
    trade = action.isin("BUY", "SELL") & (fee != 0)
    return F.when(trade & excluded & ~included, "EXCLUDED").when(trade & included & ~excluded, "INCLUDED")


def key_text(cell: Column, kind: str = "string") -> Column:
    """A cell as keys hold it: numbers to 4 places without trailing zeros, other text trimmed, null empty. `kind` is the column's type."""
    if kind == "date":
        return F.coalesce(cell.cast("string"), F.lit(""))
    plain = lambda number: F.rtrim(F.rtrim(number.cast("decimal(34,4)").cast("string"), F.lit("0")), F.lit("."))
    if kind.startswith("decimal") or kind in ("bigint", "int"):
        return F.coalesce(plain(cell), F.lit(""))
    text = F.trim(cell.cast("string"))
    # what starts like no number needs no cast
    return F.coalesce(F.when(text.rlike(r"^[-+.]?[0-9.]"), plain(text.try_cast("decimal(34,10)"))), text, F.lit(""))


def essentials_hash(columns: list[Column], kinds: list[str] | None = None) -> Column:
    """SHA-256 of what identifies a row."""
    return F.sha2(F.concat_ws("|", *[key_text(c, k) for c, k in zip(columns, kinds or ["string"] * len(columns), strict=True)]), 256)
