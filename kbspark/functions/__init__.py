"""kbspark.functions"""
