"""driftline.streaming"""
