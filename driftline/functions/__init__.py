"""driftline.functions"""
