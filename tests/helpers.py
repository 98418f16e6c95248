"""Points that several tests use."""

import datetime as dt

A, B, C, D = (43.8430139, 10.507994), (43.54427, 10.32615), (43.70853, 10.4036), (43.77925, 11.24626)
TWENTY = {
    1: [(3, 8, A), (3, 9, B), (3, 10, C), (4, 10, D)],
    2: [(3, 8, A), (3, 9, C), (4, 10, A), (4, 11, B)],
    3: [(3, 8, B), (3, 9, C), (4, 10, A), (4, 11, D)],
    4: [(4, 10, C), (4, 11, B), (4, 12, D)],
    5: [(4, 10, C), (4, 11, D), (5, 12, A)],
    6: [(4, 10, A), (4, 11, B)],
}


def rows_of(users):
    out, i = [], 0
    for uid, points in users.items():
        for day, hour, (lat, lng) in points:
            out.append((i, uid, lat, lng, dt.datetime(2011, 2, day, hour, 34, 4)))
            i += 1
    return out


def by_uid(df, name):
    return [r[name] for r in df.orderBy("uid").collect()]
