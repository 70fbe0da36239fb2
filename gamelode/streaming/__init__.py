"""gamelode.streaming"""
