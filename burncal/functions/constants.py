"""Regions, prototypes of burn regimes, and the weights of two linear models."""

#: Region key -> west, south, east, north.
REGIONS = {
    "amazon": (-74.0, -12.0, -46.0, 2.0),
    "california": (-125.0, 32.0, -114.0, 42.0),
    "canada": (-140.0, 52.0, -95.0, 70.0),
    "siberia": (100.0, 50.0, 145.0, 70.0),
    "congo": (8.0, -8.0, 32.0, 8.0),
    "borneo": (95.0, -6.0, 120.0, 6.0),
    "australia": (112.0, -42.0, 154.0, -10.0),
    "mediterranean": (-8.0, 30.0, 32.0, 46.0),
    "bangladesh": (88.0, 20.6, 92.9, 26.7),
}

#: Sub-areas of one region.
AOIS = {
    "bd_full": (88.0, 20.6, 92.9, 26.7),
    "sundarbans": (88.0, 21.5, 89.9, 22.9),
    "rajshahi": (88.0, 24.0, 89.8, 25.6),
    "dhaka": (90.0, 23.6, 90.9, 24.4),
    "chattogram": (91.5, 20.7, 92.7, 22.8),
    "sylhet": (91.3, 23.9, 92.7, 25.4),
}

#: Relative fire season of that region, January to December.
SEASON = (2, 2, 3, 3, 2, 0, 0, 0, 0, 1, 2, 2)

#: Key, label, then peak month (from 0), seasonality, interannual CV, night fraction, mean power, log10 of the median count.
PROTOTYPES = [
    ("amazon", "Amazon Basin", 8, 14.77, 0.414, 0.435, 12.7, 4.3),
    ("california", "California / US West", 8, 12.07, 1.032, 0.439, 22.1, 3.31),
    ("canada", "Boreal Canada", 7, 32.97, 1.331, 0.352, 16.5, 3.38),
    ("siberia", "Eastern Siberia", 6, 30.49, 0.676, 0.371, 10.8, 3.87),
    ("congo", "Congo Basin", 0, 3.72, 0.261, 0.163, 10.6, 5.34),
    ("borneo", "Borneo & Sumatra", 8, 12.21, 0.851, 0.477, 9.5, 3.8),
    ("australia", "Australia", 9, 3.46, 0.417, 0.324, 13.2, 4.93),
    ("mediterranean", "Mediterranean Basin", 7, 3.82, 0.247, 0.332, 6.8, 4.18),
]

#: Logistic model of an extreme month; the last eight features are the regions but the first.
EVENT_MODEL = {
    "mean": [42229.92929292929, 40699.01545760637, 35941.82920110193, 671293.5330578513, 0.5760390542844969, 0.16556542528182683, -0.002066115702479348, 0.007710848775968706, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111, 0.1111111111111111],
    "scale": [132936.0158394028, 105110.72491568887, 107193.09648412162, 2145612.010567919, 0.38710845166908614, 0.21933221908134193, 0.7049089002219966, 0.7092529283442355, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443, 0.31426968052735443],
    "coef": [-0.7324180049797496, 0.3724348731661979, -0.2911352439364084, -0.6234063435864307, 2.143183169373479, 0.1381254518714179, 0.2852600893432781, -0.4795966120634166, -0.2534597179519355, -0.2449882757772252, 0.10232181262163641, 0.18852452545038773, -0.0675440901389126, -0.15698099528352943, -0.2463787347305155, 0.05528453738081439],
    "intercept": -1.485276703671741,
}

#: Logistic model of the next day's footprint; densities over 0.10, 0.35, 0.80 degrees, power, last day, day before, place, season.
FOOTPRINT_MODEL = {
    "cell": 0.05,
    "mean": [0.00638308, 0.02736626, 0.06471304, 0.01710095, 0.02618814, 0.02365648, 0.5, 0.5, -0.97591415, -0.21770173],
    "scale": [0.03242032, 0.07699026, 0.12358048, 0.05775981, 0.07289529, 0.06979758, 0.28923799, 0.28970624, 0.00306078, 0.01371749],
    "coef": [0.80798999, -1.51243342, 0.91895821, -0.15980066, 3.85334043, 0.37649277, 0.24599542, -0.39593176, -0.1285444, 0.10030296],
    "intercept": -0.39503833,
}
