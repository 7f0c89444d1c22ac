"""kbspark.sources"""
