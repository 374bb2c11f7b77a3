"""driftline.sources"""
