from datetime import datetime, timedelta, timezone


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def naive(text):
    return datetime.fromisoformat(text)


def seconds(n):
    return datetime.fromtimestamp(n, tz=timezone.utc)


def hours_after(start, n):
    return start + timedelta(hours=n)


def column(df, name):
    return [r[name] for r in df.collect()]
