from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def bag(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def spark_bag(df):
    return bag([tuple(r) for r in df.collect()], df.columns)


def duck_bag(con, sql):
    cur = con.execute(sql)
    return bag(cur.fetchall(), [d[0] for d in cur.description]), sorted(d[0] for d in cur.description)
