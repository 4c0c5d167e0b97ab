"""Cells and the records they combine to. Fixed values."""

CSV_FIELDS = [
    ("BaseQRankSum", "float", "1"), ("ClippingRankSum", "float", "1"), ("MQRankSum", "float", "1"), ("ReadPosRankSum", "float", "1"), ("MQ", "float", "1"), ("RAW_MQ", "float", "1"), ("MQ0", "int", "1"),
    ("dp", "int", "1"), ("dp_format", "int", "1"), ("gq", "int", "1"), ("sb", "int", "4"), ("ad", "int", "R"), ("pl", "int", "G"), ("pgt", "string", "1"), ("pid", "string", "1"), ("min_dp", "int", "1"), ("gt", "int", "P"),
]
CSV_LINES = [
    "0,12140,12294,C,&,,0,,,,,,,,,2,0,,,,,0,3,0,0,0,,,0,2,0,0",
    "1,12144,12276,C,&,,0,,,,,,,,,3,0,,,,,0,3,0,0,0,,,0,2,0,0",
    "0,17384,17384,G,A|&,475.77,1,0,-2.096,-1.859,-0.329,0.005,31.72,5.5,8,,80,99,58,0,22,0,3,58,22,17,6,504,0,9807,678,1870,2548,0|1,17385_G_A,,2,0,1",
    "1,17384,17384,G,T|&,3302.77,1,0,-2.074,0.555,-1.369,-0.101,29.82,2.5,3,120,120,99,0,0,0,0,3,0,120,37,6,3336,358,0,4536,958,7349,0|1,17385_G_T,,2,1,1",
    "2,17384,17384,G,A|&,989.77,0,1.046,-2.242,-0.432,2.055,59.37,,0,76,76,99,9,31,13,23,3,40,36,0,6,1018,0,1116,1137,1224,2361,,,,2,0,1",
]
#: row, begin, end, REF, ALT, GT, DP, DP_FORMAT, AD, PL, BaseQRankSum, MQ
DELETIONS = [
    (0, 8029499, 8029501, "TGG", ["T", "<NON_REF>"], [0, 1], 9, 8, [6, 2, 0], [40, 0, 197, 58, 203, 262], 1.067, 55.72),
    (1, 8029499, 8029501, "TGG", ["T", "TG", "<NON_REF>"], [0, 2], 103, 78, [45, 1, 32, 0], [733, 872, 3465, 0, 1789, 1573, 862, 2677, 1670, 2532], 1.82, 59.59),
    (2, 8029499, 8029500, "TG", ["T", "<NON_REF>"], [0, 1], 85, 57, [47, 10, 0], [89, 0, 1086, 229, 1119, 1348], -0.703, 60.25),
]
MIN_PL_VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tHG01958
1\t1274365\t.\tTAA\tT,TA,<NON_REF>\t562.77\t.\tDP=26;MQRankSum=-1.011;RAW_MQ=93600;ReadPosRankSum=0.578\tGT:AD:DP:GQ:PL:SB\t1/2:1,7,16,0:24:99:591,353,368,166,0,123,542,379,171,547:1,0,12,11
"""
TRIPLOID = [
    (0, 17384, 17384, "G", ["A", "<NON_REF>"], [0, 1, 0], [504, 0, 9807, 678, 1870, 2548, 123, 456, 789, 12]),
    (1, 17384, 17384, "G", ["T", "<NON_REF>"], [1, 1], [3336, 358, 0, 4536, 958, 7349]),
    (2, 17384, 17384, "G", ["A", "<NON_REF>"], [0, 1], [1018, 0, 1116, 1137, 1224, 2361]),
    (3, 17383, 17385, "TGG", ["T", "TG", "<NON_REF>"], [0, 1, 0], [40, 0, 197, 58, 203, 262, 123, 456, 789, 12, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]),
]
TRIPLOID_PL = {
    (17384, 0): "504,0,9807,678,1870,2548,123,456,789,12,1870,2548,123,456,789,12,456,789,12,12,1870,2548,123,456,789,12,456,789,12,12,456,789,12,12,12",
    (17384, 3): "40,0,6,9,0,6,9,6,9,9,203,3,8,3,8,8,456,5,5,12,0,6,9,6,9,9,3,8,8,5,6,9,9,8,9",
    (17385, 3): "40,203,456,12,0,3,5,6,8,9",
}
